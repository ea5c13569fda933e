"""Repeated passages by suffix order, over a collection dealt out by content.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller id.  Equal windows have equal minimizers (the least hash
of their 24-byte grams), so:

1. documents are hashed to blocks, written once as a table bucketed by block;
   each block sends its distinct minimizers, packed, to hash buckets;
2. a bucket answers which minimizers other blocks have too (one bit each);
3. each block sends the stretches of windows with such a minimizer (each distinct
   stretch once, with its smallest document id) to buckets, where the
   Burrows-Wheeler transform and common prefixes of the stretches are built
   column by column (``bwt.collection``) and every window gets the smallest id
   that has it;
4. each block marks its documents' bytes by the answers.

A passage with any number of copies costs one stretch for each block.  A minimizer
that very many blocks share is sent window by window, dealt by the whole window,
so that no bucket holds all that has it.  No text is shuffled but once.
"""

from __future__ import annotations

import atexit
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import least_of_windows
from .common import drop_shuffles, shared_dir, written

WINDOW, GRAM = 50, 24
#: Bytes of text in a block, and the most of them; blocks to a bucket; windows in a stretch; strings in one transform.
BLOCK_BYTES, MOST_BLOCK_BYTES, PER_BUCKET, LONGEST, STRINGS = 4_000_000, 256_000_000, 4, WINDOW - GRAM + 1, 4096
#: Blocks up to which a block keeps its size; beyond them blocks grow with the root of the input, so that a
#: message from a block to a bucket never shrinks to nothing.  Spark allows 100,000 files of a bucketed table.
STEADY_BLOCKS, MOST_FILES = 10_000, 50_000
#: Blocks that share a minimizer from which on its windows are dealt one by one.
HOT_BLOCKS = 2000
#: Bytes of a long document whose windows are hashed at a time.
SEGMENT = 1 << 18
NO_ID = (1 << 63) - 1

MESSAGE = "block long, bucket int, kind int, payload binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"

_B1 = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (24) bytes from each position on, by doubling to 8 and 16."""
    c, power = b.astype(np.uint64) + np.uint64(1), _B1
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            c = c[:-step] * power + c[step:]
            power = power * power
        n = len(b) - GRAM + 1
        return _mix((c[:n] * power + c[8 : 8 + n]) * power + c[16 : 16 + n])


def _slide(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


class Block:
    """The documents of a block in a fixed order, and their stretches."""

    def __init__(self, table: pa.Table):
        given = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        rows = sorted((NO_ID if x is None else x, t, x is None) for x, t in zip(given, texts, strict=True))
        self.texts = [t for _, t, _ in rows]
        self.ids = np.array([i for i, _, _ in rows], np.int64)
        self.named = [None if none else i for i, _, none in rows]
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)])
        self.raw = b"".join(self.texts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        parts = [self._stretches(a, z) for a, z in self._segments()]
        self.start, self.n, self.key = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1

    def _segments(self) -> Iterator[tuple[int, int]]:
        total = len(self.bytes)
        for a in range(0, total, SEGMENT):
            yield a, min(total, a + SEGMENT + WINDOW - 1)

    def _stretches(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.bytes[a:z]
        if len(b) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = _slide(_grams(b), WINDOW - GRAM + 1)
        # windows that do not run past the end of their document
        place = np.arange(a, a + len(low))
        first, last = np.searchsorted(self.begin, [a, a + len(low)], "right")
        good = np.ones(len(low), bool)
        for end in self.begin[first : last + 1].tolist() if last - first < 64 else ():
            good[max(0, end - WINDOW + 1 - a) : max(0, end - a)] = False
        if last - first >= 64:
            ends = self.begin[np.searchsorted(self.begin, place, "right")]
            good = place + WINDOW <= ends
        at = np.flatnonzero(good)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        key = low[at]
        cut = np.flatnonzero((np.diff(at) != 1) | (key[1:] != key[:-1])) + 1
        begin = np.concatenate([[0], cut])
        n = np.diff(np.append(begin, len(at)))
        if (n > LONGEST).any():
            pieces = -(-n // LONGEST)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, left = np.repeat(begin, pieces) + k * LONGEST, np.repeat(n, pieces) - k * LONGEST
            n = np.minimum(left, LONGEST)
        return at[begin] + a, n, key[begin]

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers in order, and whether two ids of this block have it."""
        order = np.argsort(self.key, kind="stable")
        key, ids = self.key[order], self.ids[self.doc[order]]
        if not len(key):
            return key, np.zeros(0, bool)
        run = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        return key[run], np.minimum.reduceat(ids, run) != np.maximum.reduceat(ids, run)

    def wanted(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the stretches whose minimizer others have; cut those of hot ones into windows."""
        distinct, twice = self.minimizers()
        if not len(distinct):
            return
        where = np.searchsorted(distinct, self.key)
        keep, split = (shared | twice)[where], hot[where]
        n = np.where(split, self.n, 1)[keep]
        start, size, key, doc = (x[keep] for x in (self.start, self.n, self.key, self.doc))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        split = np.repeat(split[keep], n)
        self.start, self.doc = np.repeat(start, n) + k, np.repeat(doc, n)
        self.n, self.key = np.where(split, 1, np.repeat(size, n)), np.repeat(key, n)
        for i in np.flatnonzero(split).tolist():
            self.key[i] = np.frombuffer(_digest(self.raw[self.start[i] : self.start[i] + WINDOW]), np.uint64)[0]

    def strings(self, buckets: int) -> tuple[dict[int, dict[bytes, tuple[int, int, int]]], np.ndarray, np.ndarray]:
        """By bucket, in order of first sight: each distinct stretch with its smallest id, its key and its place; then the bucket and place of each stretch."""
        out: dict[int, dict[bytes, tuple[int, int, int]]] = {}
        home = ((self.key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        stop = (self.start + self.n + WINDOW - 1).tolist()
        raw, places = self.raw, []
        for h, a, z, i, k in zip(home.tolist(), self.start.tolist(), stop, self.ids[self.doc].tolist(), (self.key & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
            box = out.get(h)
            if box is None:
                box = out[h] = {}
            s = raw[a:z]
            found = box.get(s)
            if found is None:
                # documents come by id: the first to have a stretch is the smallest
                found = box[s] = (i, k, len(box))
            places.append(found[2])
        return out, home, np.array(places, np.int64)


def _digest(x: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(x, 9)


_pack = lambda x: zstandard.ZstdCompressor(level=1).compress(x)
_unpack = lambda x: zstandard.ZstdDecompressor().decompress(x)


def _message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "kind", "payload"])


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each minimizer, and their order by bucket and 40 more bits."""
    home = (key % np.uint64(buckets)).astype(np.int64)
    rest = (key // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
    return home, np.lexsort((rest, home))


def _send_minimizers(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        key, _ = Block(table).minimizers()
        block = table.column("block")[0].as_py()
        home, order = _dealt(key, buckets)
        rest = ((key // np.uint64(buckets)) & np.uint64((1 << 40) - 1))[order]
        home = home[order]
        rows = []
        for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(home)) + 1) if len(key) else []:
            steps = np.diff(rest[part], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((block, int(home[part[0]]), 0, _pack(steps.T.tobytes())))
        return _message(rows)

    return run


def _answer_minimizers(hot: int):
    def run(table: pa.Table) -> pa.Table:
        values = []
        for payload in table.column("payload").to_pylist():
            planes = np.frombuffer(_unpack(payload), np.uint8).reshape(5, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, :5] = planes.T
            values.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64))
        sizes = np.array([len(v) for v in values])
        _, back, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        often = count[back]
        rows = []
        for block, bucket, a, z in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            o = often[a:z]
            rows.append((block, bucket, 1, _pack(np.packbits(o > 1).tobytes() + np.packbits(o > hot).tobytes())))
        return _message(rows)

    return run


def _answered(block: Block, messages: pa.Table, buckets: int) -> None:
    """Keep the stretches that the answers (kind 1) ask for."""
    key, _ = block.minimizers()
    shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        home, order = _dealt(key, buckets)
        said = {b: p for b, k, p in zip(*(messages.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if k == 1}
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            bits = np.frombuffer(_unpack(said[int(home[part[0]])]), np.uint8).reshape(2, -1)
            shared[part], hot[part] = (np.unpackbits(x)[: len(part)].astype(bool) for x in bits)
    block.wanted(shared, hot)


def _send_strings(buckets: int):
    def run(_key, texts: pa.Table, messages: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _message([])
        block = Block(texts)
        _answered(block, messages, buckets)
        name = texts.column("block")[0].as_py()
        rows = []
        for bucket, box in sorted(block.strings(buckets)[0].items()):
            lengths = np.fromiter(map(len, box), np.uint8, len(box))
            ids = np.array([x[0] for x in box.values()], "<i8")
            keys = np.array([x[1] for x in box.values()], "<u4")
            rows.append((name, bucket, 2, _pack(struct.pack("<q", len(box)) + lengths.tobytes() + keys.tobytes() + ids.view(np.uint8).reshape(-1, 8).T.tobytes() + b"".join(box))))
        return _message(rows)

    return run


def _order_strings(table: pa.Table) -> pa.Table:
    """For each block's strings, in the order they came: the smallest id that has each window."""
    place: dict[tuple[int, bytes], int] = {}
    least: list[int] = []
    asked: list[list[int]] = []
    for payload in table.column("payload").to_pylist():
        raw = _unpack(payload)
        (n,) = struct.unpack_from("<q", raw)
        lengths = np.frombuffer(raw, np.uint8, n, 8)
        keys = np.frombuffer(raw, "<u4", n, 8 + n).tolist()
        ids = np.frombuffer(raw, np.uint8, 8 * n, 8 + 5 * n).reshape(8, n).T.copy().view("<i8").ravel().tolist()
        at = 8 + 13 * n
        mine = []
        for k, i, z in zip(keys, ids, (np.cumsum(lengths, dtype=np.int64) + at).tolist(), strict=True):
            s = (k, raw[at:z])
            at = z
            p = place.get(s)
            if p is None:
                p = place[s] = len(least)
                least.append(i)
            elif i < least[p]:
                least[p] = i
            mine.append(p)
        asked.append(mine)
    names = list(place)
    found: list[np.ndarray | None] = [None] * len(names)
    value = np.array(least, np.int64)
    # strings with one key stay together; one that has its key alone shares no window with another
    order = sorted(range(len(names)), key=lambda p: names[p][0])
    sorted_keys = np.array([names[p][0] for p in order], np.int64)
    alone = np.ones(len(order), bool)
    same = sorted_keys[1:] == sorted_keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    for p in itertools.compress(order, alone.tolist()):
        found[p] = np.full(len(names[p][1]) - WINDOW + 1, least[p], np.int64)
    order = list(itertools.compress(order, (~alone).tolist()))
    at = 0
    while at < len(order):
        z = min(len(order), at + STRINGS)
        while z < len(order) and names[order[z]][0] == names[order[z - 1]][0]:
            z += 1
        some = order[at:z]
        for p, w in zip(some, least_of_windows([names[p][1] for p in some], value[some], WINDOW), strict=True):
            found[p] = w
        at = z
    rows = []
    for block, bucket, mine in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), asked, strict=True):
        rows.append((block, bucket, 3, _pack(np.concatenate([found[p] for p in mine]).astype("<i8").tobytes())))
    return _message(rows)


def _mark(buckets: int):
    def run(_key, texts: pa.Table, messages: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        if not texts.num_rows:
            return schema.empty_table()
        block = Block(texts)
        _answered(block, messages, buckets)
        said = {b: p for b, k, p in zip(*(messages.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if k == 3}
        boxes, home, place = block.strings(buckets)
        # the windows of all distinct stretches in a row, bucket after bucket
        answers = np.concatenate([np.frombuffer(_unpack(said[h]), "<i8") for h in boxes]) if boxes else np.zeros(0, np.int64)
        sizes = np.fromiter((len(x) - WINDOW + 1 for box in boxes.values() for x in box), np.int64)
        ahead = np.zeros(buckets, np.int64)
        counts = np.array([len(box) for box in boxes.values()], np.int64)
        ahead[list(boxes)] = np.cumsum(counts) - counts
        gone = np.zeros(len(block.bytes) + 1, bool)
        if boxes:
            at = (np.cumsum(sizes) - sizes)[ahead[home] + place]
            k = np.arange(block.n.sum()) - np.repeat(np.cumsum(block.n) - block.n, block.n)
            gone[np.repeat(block.start, block.n) + k] = answers[np.repeat(at, block.n) + k] < np.repeat(block.ids[block.doc], block.n)
        # a byte is covered if any of the WINDOW starts up to it is gone
        sums = np.cumsum(gone[:-1], dtype=np.int64)
        covered = sums > 0
        covered[WINDOW:] = sums[WINDOW:] > sums[:-WINDOW]
        rows = []
        for k, text in enumerate(block.texts):
            c = covered[block.begin[k] : block.begin[k + 1]]
            doc = block.named[k]
            if not c.any():
                rows.append((doc, len(text), [], text))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]])))
            rows.append((doc, len(text), [{"start": a, "stop": z} for a, z in edge.reshape(-1, 2).tolist()], np.frombuffer(text, np.uint8)[~c].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (removed bytes, start and stop) and kept (what is left).

    Texts are UTF-8 bytes, null is empty; matches never cross documents and are
    judged on the input.  Texts under WINDOW bytes lose nothing.  Rows with one
    id do not remove from each other; a null id counts as the largest long, and so
    larger than any other.  An empty table gives no rows.  Long documents are read whole."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > STEADY_BLOCKS:
        blocks = -(-total // min(MOST_BLOCK_BYTES, int(block_bytes * (blocks / STEADY_BLOCKS) ** 0.5)))
    # by id and text, so that the rows of one id, or of none, are not one block
    dealt = text.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    buckets = max(1, blocks // PER_BUCKET)
    files = min(MOST_FILES, buckets)
    name = f"repeats_{uuid.uuid4().hex}"
    (
        dealt.repartition(files, "block").write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
        .bucketBy(files, "block").saveAsTable(name)
    )
    atexit.register(_drop, spark, name)
    drop_shuffles(spark)
    texts = spark.table(name).select("block", "doc_id", "text")

    sent = texts.groupBy("block").applyInArrow(_send_minimizers(buckets), MESSAGE)
    flags = written(sent.groupBy("bucket").applyInArrow(_answer_minimizers(hot_blocks), MESSAGE), "repeats-flags")
    drop_shuffles(spark)
    strings = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send_strings(buckets), MESSAGE)
    answers = written(strings.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_order_strings, MESSAGE), "repeats-answers")
    drop_shuffles(spark)
    both = flags.unionByName(answers)
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_mark(buckets), RESULT)


def _drop(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may have ended
        pass
