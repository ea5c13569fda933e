"""SimHash near-duplicates through deletion-variant signatures.

Every text gets a 64-bit SimHash of its word shingles.  Two fingerprints that
differ in at most two bits differ in at most one bit in one of their two
32-bit segments, so a segment with one position deleted (a one-wildcard
variant: 32 for each segment) is equal for both.  An index of these variants
over the distinct fingerprints is dealt out by key; within a key the whole
fingerprints are compared.

No bucket emits its pairs: it emits a spanning forest of its links, which joins
the same fingerprints.  A bucket too large to compare in one task (``LARGE``)
marks its members instead, and these get every two-wildcard variant of the
whole fingerprint: equal variants are links by themselves, so each key is a
star and the work grows with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Members up to which a bucket is compared within one task.
LARGE = 2048
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, words: int = 3) -> int:
    """The fingerprint of a text in UTF-8: words at ASCII white space, A-Z lower-cased; no word: 0."""
    ws = text.translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    digest = xxhash.xxh64_digest
    if len(ws) <= words:
        return int.from_bytes(digest(joined, 42), "big")
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    stops = ends[words - 1 :]
    n = len(stops)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)])
        counts += _bit_counts(np.frombuffer(raw, ">u8").astype(np.uint64))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each bit set, most significant first; eight counters share a word."""
    counts = np.zeros(64, np.int64)
    for shift in range(8):
        lanes = (h >> np.uint64(shift)) & _LANES
        full = len(lanes) // 255 * 255
        sums = lanes[:full].reshape(-1, 255).sum(axis=1, dtype=np.uint64) if full else np.zeros(0, np.uint64)
        sums = np.append(sums, lanes[full:].sum(dtype=np.uint64))
        # byte k of a sum counts bit 8 * k + shift
        counts[63 - shift - 8 * np.arange(8)] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x, words) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """(64, len(fp)) keys: segment and deleted position in the high bits, the 31 bits that are left below."""
    out = np.empty((64, len(fp)), np.int64)
    for seg in range(2):
        half = (fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
        for i in range(32):
            low = half & np.uint64((1 << i) - 1)
            high = (half >> np.uint64(i + 1)) << np.uint64(i)
            out[32 * seg + i] = (low | high | (np.uint64(32 * seg + i) << np.uint64(32))).astype(np.int64)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        keys = variants(fp.view(np.uint64))
        for row in range(0, 64, 8):
            yield pa.RecordBatch.from_arrays([pa.array(keys[row : row + 8].ravel()), pa.array(np.tile(fp, 8))], ["key", "fp"])


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all members of one bucket that links within ``bits`` bits join."""
    n = len(fps)
    root = np.arange(n)
    links = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1
        near = near[root[near] != root[i]]
        while len(near):
            j, old = near[0], root[near[0]]
            links.append((i, int(j)))
            root[root == old] = root[i]
            near = near[root[near] != root[i]]
    return links


def _linked(bits: int, large: int):
    """Runs of equal keys in sorted rows to links; members of a run over ``large`` come out marked (a null second end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, flooded = None, [], False

        def close() -> tuple[list[np.ndarray], list[np.ndarray]]:
            fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if flooded or len(fps) < 2:
                return [], []
            links = _forest(fps, bits)
            return [fps[[i for i, _ in links]]], [fps[[j for _, j in links]]]

        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            fp = fp.view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(np.diff(key)) + 1
            a, z, marked = [], [], []
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            # whole runs of two and more inside the batch, and the first and last run
            lengths = ends - begins
            for k in np.unique(np.concatenate([[0], np.flatnonzero(lengths > 1), [len(begins) - 1]])):
                i, j = int(begins[k]), int(ends[k])
                edge = k == len(begins) - 1
                if not edge and not (k == 0 and held_key == key[i]):
                    if j - i == 2:
                        if int(np.bitwise_count(fp[i] ^ fp[i + 1])) <= bits:
                            a.append(fp[i : i + 1])
                            z.append(fp[i + 1 : j])
                    elif 2 < j - i <= large:
                        links = _forest(fp[i:j], bits)
                        a.append(fp[[i + x for x, _ in links]])
                        z.append(fp[[i + y for _, y in links]])
                    elif j - i > large:
                        marked.append(fp[i:j])
                    continue
                if held_key != key[i]:
                    more = close()
                    a += more[0]
                    z += more[1]
                    held_key, held, flooded = key[i], [], False
                held.append(fp[i:j].copy())
                if flooded or sum(map(len, held)) > large:
                    flooded = True
                    marked += held
                    held = []
                if not edge:
                    more = close()
                    a += more[0]
                    z += more[1]
                    held_key, held, flooded = None, [], False
            yield _rows(a, z, marked)
        a, z = close()
        yield _rows(a, z, [])

    return run


def _rows(a: list[np.ndarray], z: list[np.ndarray], marked: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    one, two, alone = join(a), join(z), join(marked)
    second = pa.concat_arrays([pa.array(two, pa.int64()), pa.nulls(len(alone), pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, alone])), second], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each marked fingerprint with every two bits cleared, and which two: equal keys differ in those bits at most."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(64):
            for j in range(i + 1, 64):
                gone = np.uint64((1 << i) | (1 << j))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), 64 * i + j, np.int16)), pa.array((fp & ~gone).view(np.int64)), pa.array(fp.view(np.int64))], ["pair", "key", "fp"])


def links(fps: DataFrame, bits: int = 2, large: int = LARGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all that lie within ``bits`` (at most 2) bits of one another."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments serve up to two bits")
    index = fps.mapInArrow(_index, "key long, fp long")
    dealt = index.repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_linked(bits, large), "a long, b long"), "simhash-links")
    marked = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    near = found.where("b IS NOT NULL").distinct()
    if not marked.isEmpty():
        stars = marked.mapInArrow(_stars, "pair short, key long, fp long")
        low = stars.groupBy("pair", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
        near = near.unionByName(stars.join(low, ["pair", "key"]).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))).distinct()
        near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return near


def groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for each row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint zero and are linked like any
    other; a text of fewer words than a shingle is one shingle.  Equal
    fingerprints are one node, so copies cost nothing.  Repeated rows each give a
    row.  A null doc_id takes part, and is the component's id only where no other
    is there.  An empty table gives no rows."""
    marked = written(fingerprints(docs, words), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), bits))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")

