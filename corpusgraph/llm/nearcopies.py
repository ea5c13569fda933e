"""Near copies by the similarity of their word shingles, exactly: SimHash links and prefix filtering, then verification.

A text is the set of its five-word shingles (64-bit hashes).  SimHash fingerprints
of the sets, linked through deletion-variant signatures (``simhash.links``), give
the candidates of nearly equal texts.  Two bits of 64 do not reach down to a
similarity of ``4 / 5``: for the rest, in any order that all texts share, two sets
of that similarity have one of their first ``n - ceil(4 n / 5) + 1`` shingles in
common.  So:

1. these first shingles go into an index, shingles that a sample finds common
   last, so that what many texts share is rarely among them; the order only
   decides how many candidates there are, never which links are found;
2. texts under one key are candidates where their sizes, places and sketches
   allow the similarity; candidates are verified on the whole sets;
3. a key of over ``LARGE`` texts pairs them with its first ``HUBS`` only; once
   the links so found have been joined, its texts that are still apart are compared
   by their sketches where the key lies, and the pairs that these allow are verified
   too, so that none is missed.

Every candidate of either kind is verified.  Texts of equal sets are one node.  A
row is known by its id and a hash of its text, so no text is copied or moved but
those of candidates and, where many rows go, once to part them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop_shuffles, forget, small, written
from .components import components
from .simhash import _LOWER, _bit_counts

#: Words of a shingle; the least similarity, as a fraction.
WORDS, OVER, UNDER = 5, 4, 5
#: Texts of the sample that tells common shingles, and how many of these are known.
SAMPLE_DOCS, COMMON = 4000, 200_000
#: Texts up to which a key emits all its pairs, and texts that stand for a larger one at first.
LARGE, HUBS = 4, 1
#: Most times that large keys give candidates enough to join what is apart, as long as some are links, before they give all.
SPANNING = 8
#: Fewest and most cells of a sketch; it has two for a shingle at least in between.
CELLS, MOST_CELLS = 512, 1 << 15
#: Index rows handled at a time, words whose hashes are held, parts in which the index is dealt, one after another.
ROWS, HELD, SLICES = 1 << 18, 1 << 17, 4
#: Rows of two numbers up to which a table is broadcast.
SMALL = 1_000_000

_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def shingles(text: bytes, known: _Hashes) -> np.ndarray:
    """The sorted distinct shingles of a text in UTF-8: words at ASCII white space, A-Z lower-cased; a shorter text is one."""
    ws = text.translate(_LOWER).split()
    if len(ws) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 7)] if ws else [], np.uint64)
    w = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = len(w) - WORDS + 1
    h = w[:n] * _TIMES[0]
    for i in range(1, WORDS):
        h ^= h >> np.uint64(29)
        h = h * _TIMES[0] + w[i : i + n] * _TIMES[i]
    return np.unique(h ^ (h >> np.uint64(32)))


def _node(h: np.ndarray) -> int:
    """One number for a set, as a signed long; the empty set is zero."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 3)).astype(np.int64)) if len(h) else 0


def _fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set, as a signed long; the empty set is zero."""
    return int.from_bytes(np.packbits(2 * _bit_counts(h) > len(h)).tobytes(), "big", signed=True)


def _sketch(h: np.ndarray) -> bytes:
    """Parities of the shingles in cells: two sketches differ in at most as many cells as their sets in shingles."""
    cells = min(MOST_CELLS, max(CELLS, 1 << (2 * len(h) - 1).bit_length())) if len(h) else CELLS
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x, known).view(np.int64))], ["h"])

    step = max(1, rows.count() // SAMPLE_DOCS)
    drawn = rows.where(F.pmod(F.col("h"), F.lit(step)) == 0).select("text")
    many = drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = many.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(shared):
    """Each row's node, number of shingles and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        known = _Hashes()
        for b in small(batches):
            nodes, sizes, firsts, sketches, fps = [], [], [], [], []
            for x in b.column(2).cast(pa.binary()).to_pylist():
                h = shingles(x, known)
                n = len(h)
                nodes.append(_node(h))
                sizes.append(n)
                sketches.append(_sketch(h))
                fps.append(_fingerprint(h))
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, often[at], 0), kind="stable")]
                firsts.append(h[: n - -(-OVER * n // UNDER) + 1 if n else 0].tobytes())
            found = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(firsts, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], ["doc_id", "h", "node", "n", "fp", "firsts", "sketch"])

    return run


def _index(k: int):
    """Part ``k`` of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for node, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if node in seen or not raw:
                    continue
                if len(seen) < HELD:
                    seen.add(node)
                key = np.frombuffer(raw, np.int64)
                place = np.flatnonzero(key % SLICES == k).astype(np.int32)
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array(key[place]), pa.array(np.full(len(place), node, np.int64)), pa.array(np.full(len(place), n, np.int32)), pa.array(place)], ["key", "node", "n", "place"])

    return run


def _allowed(n: np.ndarray, place: np.ndarray, i, j) -> np.ndarray:
    """Whether sizes and places of a shared shingle leave room for the similarity."""
    both = n[i] + n[j]
    most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
    return (UNDER * np.minimum(n[i], n[j]) >= OVER * np.maximum(n[i], n[j])) & ((OVER + UNDER) * most >= OVER * both)


def _runs(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, numbers or binary, in parts that hold whole runs of the first one."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([x if (x := c.to_numpy(zero_copy_only=False)).dtype == object else x.astype(np.int64) for c in b.columns])
        rows += b.num_rows
        if rows >= most:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [c[:cut] for c in whole]
            held, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


FOUND = "a long, b long, key long, n int, place int"


def _pairs(most: int, hubs: int):
    """Candidates of each key; texts of a large key besides, without a second end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, place in _runs(batches):
            # the same text may have come from several tasks
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, n, place = key[new], node[new], n[new], place[new]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(begins, len(key)))
            of = np.repeat(np.arange(len(begins)), lengths)
            rank = np.arange(len(key)) - begins[of]
            large = lengths[of] > most
            ends = []
            for d in range(1, min(most, int(lengths.max()))):
                j = np.flatnonzero(~large & (rank >= d))
                if not len(j):
                    break
                ok = _allowed(n, place, j - d, j)
                ends.append((j[ok] - d, j[ok]))
            for d in range(hubs):
                j = np.flatnonzero(large & (rank > d))
                i = begins[of[j]] + d
                ok = _allowed(n, place, i, j)
                ends.append((i[ok], j[ok]))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
            if len(i):
                two = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                gone = lambda kind, k=two.shape[1]: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1]), gone(pa.int64()), gone(pa.int32()), gone(pa.int32())], ["a", "b", "key", "n", "place"])
            m = np.flatnonzero(large)
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(node[m]), pa.nulls(len(m), pa.int64()), pa.array(key[m]), pa.array(n[m].astype(np.int32)), pa.array(place[m].astype(np.int32))], ["a", "b", "key", "n", "place"])

    return run


def _apart(spanning: int | None):
    """Candidates of large keys whose ends are not joined yet and whose sketches allow the similarity; rows are key, node, n, place, root, sketch.

    ``spanning``: of these only so many that, were all of them links, they would
    join what all candidates of the key would; at 0 those of the closest sketches, at
    other numbers others, for a close one may be no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = np.random.default_rng(spanning)
        for key, node, n, place, root, sketch in _runs(batches, ROWS // 64):
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(key)], strict=True):
                kinds, of, count = np.unique(root[a:z], return_inverse=True, return_counts=True)
                if len(kinds) == 1:
                    continue
                # those of the largest component are compared with all others, not with one another
                largest = of == count.argmax()
                # sketches of as many cells are the rows of one table
                held = [np.frombuffer(x, np.uint64) for x in sketch[a:z]]
                cells = np.array([len(x) for x in held])
                tables = {int(c): (np.flatnonzero(cells == c), np.stack([x for x in held if len(x) == c])) for c in np.unique(cells)}
                found = []
                for i in np.flatnonzero(~largest):
                    ends, far = [], []
                    for c, (rows, table) in tables.items():
                        # a pair of two such components comes once
                        room = (of[rows] != of[i]) & (largest[rows] | (rows > i))
                        room[room] = _allowed(n[a:z], place[a:z], i, rows[room])
                        if not room.any():
                            continue
                        one, two = held[i], table[room]
                        while len(one) > c:
                            one = one[: len(one) // 2] ^ one[len(one) // 2 :]
                        while two.shape[1] > len(one):
                            two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
                        differ = np.bitwise_count(two ^ one).sum(1, dtype=np.int64)
                        good = (OVER + UNDER) * differ <= (UNDER - OVER) * (n[a + i] + n[a + rows[room]])
                        ends.append(rows[room][good])
                        far.append(drawn.random(good.sum()) if spanning else differ[good] / (n[a + i] + n[a + rows[room][good]]))
                    if not ends or not len(j := np.concatenate(ends)):
                        continue
                    if spanning is not None:
                        j = j[np.argsort(np.concatenate(far), kind="stable")]
                        joined, first = np.unique(of[j], return_index=True)
                        j = j[first]
                        of[np.isin(of, joined)] = of[i]
                    found.append((np.full(len(j), i), j))
                if found:
                    i, j = (a + np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(key[i])], ["a", "b", "key"])

    return run


def _held(column: pa.Array) -> Iterator[np.ndarray]:
    """The binary values of a column as 64-bit numbers, one after another, where they lie in memory."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    for a, z in zip(ends, ends[1:]):
        yield np.frombuffer(data, np.uint8)[a:z].view(np.uint64) if z > a else np.zeros(0, np.uint64)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose sketches allow the similarity; rows are a, b, sizes of both together, sketches of both."""
    for b in batches:
        differ = np.zeros(b.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(_held(b.column(3)), _held(b.column(4)), strict=True)):
            # a sketch with twice the cells is folded: what falls into one cell then has the parity of both
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            differ[k] = int(np.bitwise_count(x ^ y).sum())
        good = (OVER + UNDER) * differ <= (UNDER - OVER) * b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pc.filter(b.column(i), pa.array(good)) for i in range(2)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()
    seen: set[int] = set()
    for b in small(batches):
        nodes = b.column(0).to_pylist()
        new = []
        for i, node in enumerate(nodes):
            if node not in seen:
                new.append(i)
                if len(seen) < HELD:
                    seen.add(node)
        texts = b.column(1).cast(pa.binary()).take(pa.array(new, pa.int64())).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), pa.array([shingles(x, known).tobytes() for x in texts], pa.binary())], ["node", "all"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for one, two in zip(_held(b.column(2)), _held(b.column(3)), strict=True):
            both = len(np.intersect1d(one, two, assume_unique=True))
            good.append(UNDER * both >= OVER * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([pc.filter(b.column(i), pa.array(good, pa.bool_())) for i in range(2)], ["a", "b"])


def _beside(rows: DataFrame, few: DataFrame, on, how: str) -> DataFrame:
    """A join that leaves ``rows`` where they lie if the written table ``few`` has at most SMALL rows."""
    return rows.join(F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few, on, how)


def _verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose whole sets are similar enough."""
    spark = pairs.sparkSession
    side = lambda end: firsts.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).cast("long"), "s_a", "s_b")
    pairs = written(both.mapInArrow(_close, "a long, b long"), "near-pairs")
    drop_shuffles(spark)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(firsts.select("node", "doc_id", "h"), "node")
    wanted = written(wanted.select("node", F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "near-wanted")
    drawn = _beside(texts, wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "inner")
    # one row for a node, however often its row is repeated
    sets = drawn.select("node", "text").mapInArrow(_sets, "node long, all binary").groupBy("node").agg(F.first("all").alias("all"))
    sets = written(sets, "near-sets")
    drop_shuffles(spark)
    one, two = sets.toDF("a", "_one"), sets.toDF("b", "_two")
    # a pair takes its sets along: at a time, pairs of a quarter of what all sets hold
    moved = pairs.join(firsts.select(F.col("node").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
    held = firsts.agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-4 * moved // max(1, held)))
    links = []
    for k in range(slices):
        part = pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
        links.append(written(part.join(one, "a").join(two, "b").select("a", "b", "_one", "_two").mapInArrow(_similar, "a long, b long"), "near-links"))
        drop_shuffles(spark)
    forget(pairs, wanted, sets)
    return reduce(DataFrame.unionByName, links)


def _fingerprinted(marked: DataFrame) -> DataFrame:
    """Candidates (a, b: nodes) whose fingerprints are equal or linked: one node of each fingerprint with its others, and with those of its links."""
    nodes = written(marked.select("fp", "node").distinct(), "near-fingerprints")
    one = nodes.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    equal = nodes.join(one.where("n > 1"), "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(one.select("fp"), bits=2)
    ends = lambda c, to: one.select(F.col("fp").alias(c), F.col("low").alias(to))
    return equal.unionByName(linked.toDF("_a", "_b").join(ends("_a", "a"), "_a").join(ends("_b", "b"), "_b").select("a", "b"))


def groups(docs: DataFrame, large: int = LARGE, hubs: int = HUBS) -> DataFrame:
    """doc_id, h (a hash of the text), node, root for each row of ``docs`` (doc_id, text): rows of one root are near copies.

    Null, empty and blank texts are copies of one another; a text of fewer words
    than a shingle is one shingle.  ``docs`` is read several times, so it must be
    a written table.  An empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    shared = spark.sparkContext.broadcast(_common(texts))
    marked = written(texts.mapInArrow(_prefixes(shared), "doc_id long, h long, node long, n int, fp long, firsts binary, sketch binary"), "near-firsts")
    parts = []
    for k in range(SLICES):
        index = marked.select("node", "n", "firsts").mapInArrow(_index(k), "key long, node long, n int, place int")
        parts.append(written(index.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pairs(large, hubs), FOUND), "near-found"))
        drop_shuffles(spark)
    found = reduce(DataFrame.unionByName, parts)
    lone = F.min(F.struct("doc_id", "h"))
    alike = marked.groupBy("node").agg(lone.alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    firsts = written(alike.select("node", "row.doc_id", "row.h", "n", "sketch"), "near-nodes")
    near = written(_fingerprinted(marked), "near-simhash")
    rows = written(marked.select("doc_id", "h", "node"), "near-rows")
    forget(marked)
    links = _verified(near.unionByName(found.where("b IS NOT NULL").select("a", "b")), firsts, texts)
    joined = components(links)
    crowded = found.where("b IS NULL").select("key", F.col("a").alias("node"), "n", "place")
    if not crowded.isEmpty():
        # few candidates join most of what is apart, so that few are left when all are taken
        spanning: int | None = 0
        held = crowded
        while True:
            rooted = written(crowded.join(joined, "node", "left").select("key", "node", "n", "place", F.coalesce("root", "node").alias("root")), "near-crowded")
            # of most keys all texts are joined by now
            several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
            left = rooted.join(several, "key", "left_semi").join(firsts.select("node", "sketch"), "node").select("key", "node", "n", "place", "root", "sketch")
            apart = written(left.repartition("key").sortWithinPartitions("key").mapInArrow(_apart(spanning), "a long, b long, key long"), "near-apart")
            drop_shuffles(spark)
            none = apart.isEmpty()
            more = links.limit(0) if none else _verified(apart.select("a", "b"), firsts, texts)
            linked = not more.isEmpty()
            if linked:
                links = links.unionByName(more)
                joined = components(links)
            # a key without candidates has none later, for what is joined stays joined
            was, crowded = (held, rooted), written(rooted.join(apart.select("key").distinct(), "key", "left_semi").select("key", "node", "n", "place"), "near-left")
            forget(*was, apart)
            held = crowded
            if none or spanning is None:
                break
            spanning = spanning + 1 if linked and spanning + 1 < SPANNING else None
        forget(crowded)
    forget(near, firsts, *parts)
    return rows.join(joined, "node", "left").select("doc_id", "h", "node", F.coalesce("root", "node").alias("root"))


def drop(docs: DataFrame, large: int = LARGE, hubs: int = HUBS) -> DataFrame:
    """``docs`` (doc_id, text, any others) with one row of each group: that of the smallest doc_id, a null one last.

    Rows are told apart by id and text, so null and repeated ids lose or keep no
    other row; of equal rows one stays.  An empty table stays empty."""
    found = written(groups(docs, large, hubs).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")), "near-groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h"))
    kept = found.groupBy("root").agg(best.alias("best"), F.sum("n").alias("all")).where("all > 1")
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.h") == F.col("h"))
    # goes: true; one of several equal rows stays: false
    fate = found.join(kept, "root").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (~stays).alias("_goes"))
    fate = written(fate, "near-fate")
    told = _beside(docs, fate, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h")), "left")
    out = told.where("_goes IS NULL").select(docs.columns)
    if not fate.where("NOT _goes").isEmpty():
        out = out.unionByName(told.where("NOT _goes").dropDuplicates(["_id", "_h"]).select(docs.columns))
    return out
