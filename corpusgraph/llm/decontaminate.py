"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as lower-cased letters and digits with one blank for what
stands between them.  A benchmark item is cut into overlapping passages of
``PASSAGE`` characters.  A passage of length ``n`` that occurs with at most ``e``
edits shares at least ``n - q + 1 - q * e`` q-grams with the region, and they all
lie on ``e + 1`` neighbouring diagonals.  So:

1. a table of q-gram hashes marks document positions; stretches with too few
   marks for any passage are left;
2. the marks that remain are counted for each passage in diagonal bands of
   ``2 * (e + 1)`` that overlap by half, and bands under the bound are left;
3. what is left is verified by an alignment inside the band.

The benchmark is a stated query set.  It is taken in blocks of bounded size, each
broadcast and run against all documents where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
#: Characters of a passage, step between passages, shortest item that is looked for (one q-gram).
PASSAGE, STEP, SHORTEST = 80, 40, Q
#: Edits allowed for each character.
RATE = 0.05
#: Characters of benchmark text in one block, and of document text handled at a time.
BLOCK_CHARS, CHUNK_CHARS = 4_000_000, 4_000_000

REGIONS = "doc_id long, item_id long, start long, stop long, edits int, passages int"

_BASE = 0x9E3779B97F4A7C15
#: Letters and digits below U+10000; the last entry stands for what has no character.
_WORDY = np.array([chr(i).isalnum() for i in range(0x10000)])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form, and where in ``text`` each comes from.  U+0000 stays: it parts documents."""
    cps = np.frombuffer(_lower(text).encode("utf-32-le", "replace"), "<u4")
    wordy = _WORDY[np.minimum(cps, 0xFFFF)] | (cps > 0xFFFF)
    gap = ~wordy
    keep = wordy | (cps == 0)
    if len(cps):
        keep[1:] |= gap[1:] & wordy[:-1]
    at = np.flatnonzero(keep)
    out = np.where(wordy[at] | (cps[at] == 0), cps[at], 32).astype(np.uint64)
    return out, at


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the ``q`` (12) code points from each position on, by doubling."""
    assert q == 12
    if len(c) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        b1 = np.uint64(_BASE)
        b2 = b1 * b1
        b4 = b2 * b2
        b8 = b4 * b4
        h2 = c[:-1] + c[1:] * b1
        h4 = h2[:-2] + h2[2:] * b2
        n = len(c) - q + 1
        h = h4[:n] + h4[4 : 4 + n] * b4 + h4[8 : 8 + n] * b8
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Passages:
    """Passages of a block of items, ready for lookup."""

    item: np.ndarray  # of each passage
    chars: np.ndarray  # (n, PASSAGE), padded with 1
    length: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    table: np.ndarray  # marks by the top bits of a hash
    shift: int
    hashes: np.ndarray  # sorted, with passage and offset of each
    owner: np.ndarray
    offset: np.ndarray


def passages(items: list[tuple[int, str]], rate: float = RATE) -> Passages | None:
    found: list[tuple[int, np.ndarray]] = []
    for item, text in items:
        c, _ = normal(text or "")
        if len(c) and c[-1] == 32:
            c = c[:-1]
        if len(c) < SHORTEST:
            continue
        ends = [*range(PASSAGE, len(c), STEP), len(c)] if len(c) > PASSAGE else [len(c)]
        found += [(item, c[max(0, end - PASSAGE) : end]) for end in ends]
    if not found:
        return None
    length = np.array([len(c) for _, c in found])
    edits = (length * rate).astype(np.int64)
    # too short for any shared q-gram after so many edits: found without edits only
    edits = np.where(length - Q + 1 - Q * edits < 1, 0, edits)
    chars = np.full((len(found), PASSAGE), 1, np.uint64)
    hashes, owner, offset = [], [], []
    for k, (_, c) in enumerate(found):
        chars[k, : len(c)] = c
        h = grams(c)
        hashes.append(h)
        owner.append(np.full(len(h), k))
        offset.append(np.arange(len(h)))
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(offset)
    order = np.argsort(h, kind="stable")
    bits = max(16, int(16 * len(h)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Passages(np.array([i for i, _ in found]), chars, length, edits, length - Q + 1 - Q * edits, table, 64 - bits, h[order], o[order], p[order])


def candidates(c: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage and lowest diagonal of each band of ``c`` that meets the bound, with the count."""
    none = (np.zeros(0, np.int64),) * 3
    h = grams(c)
    if not len(h):
        return none
    marks = p.table[(h >> np.uint64(p.shift)).astype(np.int64)]
    span = int((p.length + p.edits).max()) - Q + 1
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    # marks in the span that starts at each position
    enough = sums[np.minimum(np.arange(len(h)) + span, len(h))] - sums[:-1] >= int(p.bound.min())
    if not enough.any():
        return none
    # a position stays if any span over it has enough
    first = np.flatnonzero(enough)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, np.minimum(first + span, len(h)), -1)
    at = np.flatnonzero(marks & (np.cumsum(cover[:-1]) > 0))
    lo, hi = np.searchsorted(p.hashes, h[at]), np.searchsorted(p.hashes, h[at], "right")
    n = hi - lo
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner, diagonal = p.owner[rows], np.repeat(at, n) - p.offset[rows] + PASSAGE
    width = p.edits[owner] + 1
    band = diagonal // width
    both = np.concatenate([band, band - 1])
    who = np.concatenate([owner, owner])
    key, count = np.unique(who * np.int64(1 << 40) + both + 1, return_counts=True)
    who, band = key >> 40, (key & ((1 << 40) - 1)) - 1
    good = count >= p.bound[who]
    who, band = who[good], band[good]
    return who, band * (p.edits[who] + 1) - PASSAGE, count[good]


def aligned(c: np.ndarray, p: Passages, who: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits of each candidate's best alignment inside its band, and where in ``c`` it starts and stops."""
    if not len(who):
        return (np.zeros(0, np.int64),) * 3
    slack = int(p.edits.max())
    width = 2 * (slack + 1) + 2 * slack
    far = 1 << 34
    col = np.arange(width)
    base = low - slack
    # column k of row r stands for the text before base + r + k; cost and start share one number
    place = base[:, None] + col
    best = np.where((place >= 0) & (place <= len(c)), place + 2 * PASSAGE, far * 900)
    done = np.full(len(who), far * 900, np.int64)
    stop = np.zeros(len(who), np.int64)
    padded = np.concatenate([c, np.zeros(1, c.dtype)])
    for r in range(PASSAGE):
        live = r < p.length[who]
        place = base[:, None] + r + col  # the text character that column k takes on the diagonal
        inside = (place >= 0) & (place < len(c))
        same = padded[np.where(inside, place, len(c))] == p.chars[who, r][:, None]
        step = np.where(inside, best + np.where(same, 0, far), far * 900)
        drop = np.concatenate([best[:, 1:] + far, np.full((len(who), 1), far * 900)], axis=1)
        now = np.minimum(step, drop)
        now = np.minimum.accumulate(now - col * far, axis=1) + col * far
        best = np.where(live[:, None], now, best)
        ended = p.length[who] == r + 1
        if ended.any():
            k = best.argmin(axis=1)
            value = best[np.arange(len(who)), k]
            done = np.where(ended, value, done)
            stop = np.where(ended, base + r + 1 + k, stop)
    return done // far, done % far - 2 * PASSAGE, np.minimum(stop, len(c))


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Passages = block.value
        for b in batches:
            out = [x for part in _parts(b) for x in _found(*part, p)]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), *(pa.array(x, pa.int32()) for x in cols[4:])], ["doc_id", "item_id", "start", "stop", "edits", "passages"])

    return run


def _parts(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Documents of a batch in parts of bounded text; a long document is a part of its own."""
    ids, texts, held = [], [], 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        if ids and held + len(text) > CHUNK_CHARS // 8:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(doc)
        texts.append(text)
        held += len(text) + 1
    if ids:
        yield ids, texts


def _found(ids: list, texts: list[str], p: Passages) -> list[tuple]:
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    whole = "\0".join(t.replace("\0", " ") for t in texts)
    c, at = normal(whole)
    who, low, _ = candidates(c, p)
    rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k in range(0, len(who), 4096):
        edits, start, stop = aligned(c, p, who[k : k + 4096], low[k : k + 4096])
        for w, e, a, z in zip(who[k : k + 4096].tolist(), edits.tolist(), start.tolist(), stop.tolist(), strict=True):
            if e <= p.edits[w] and 0 <= a < z:
                a, z = int(at[a]), int(at[z - 1]) + 1
                d = int(np.searchsorted(begins, a, "right")) - 1
                if z <= begins[d + 1]:
                    rows.setdefault((d, int(p.item[w])), []).append((a - int(begins[d]), z - int(begins[d]), e))
    out = []
    for (d, item), spans in sorted(rows.items()):
        held = None
        for a, z, e in sorted(set(spans)):
            if held and a <= held[1]:
                held = [held[0], max(held[1], z), max(held[2], e), held[3] + 1]
            else:
                if held:
                    out.append((ids[d], item, *held))
                held = [a, z, e, 1]
        out.append((ids[d], item, *held))
    return out


def _blocks(benchmark: DataFrame, rate: float) -> Iterator:
    """The passages of the benchmark in broadcast blocks of bounded size."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = passages(sorted((r.item_id, r.text) for r in part.collect()), rate)
        if block is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Regions of ``docs`` (doc_id, text) that repeat a passage of ``benchmark`` (item_id, text) up to ``rate`` edits a character.

    One row for each document, item and region: doc_id, item_id, start, stop (code
    points of the text), edits (most in one passage), passages (alignments that
    the region joins).  Clean documents have no row.  Null and empty texts are
    clean.  Items under SHORTEST compared characters, null ones included, are not
    looked for; those too short to share a q-gram after an edit are found as they are.  Repeated documents each have their rows; repeated items too.
    Either table may be empty.  A document of any length is read whole."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.sparkSession.createDataFrame([], REGIONS)
    for k, block in enumerate(_blocks(benchmark, rate)):
        rows = text.mapInArrow(_search(block), REGIONS)
        found = rows if k == 0 else found.unionByName(rows)
    return found


def _clear(block, at: int):
    """Rows without those whose text (column ``at``) holds a passage of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Passages = block.value
        for b in batches:
            texts = pa.array([x or "" for x in b.column(at).to_pylist()], pa.string())
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), texts], ["row", "text"])
            clear = np.ones(b.num_rows, bool)
            for part in _parts(numbered):
                clear[[x[0] for x in _found(*part, p)]] = False
            yield b.filter(pa.array(clear))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns and repeated rows stay.

    Each row is judged by its own text where it lies, so null and repeated
    doc_ids neither save a row nor cost another."""
    for block in _blocks(benchmark, rate):
        docs = docs.mapInArrow(_clear(block, docs.columns.index("text")), docs.schema)
    return docs
