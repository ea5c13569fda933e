"""Which strings of a stated set stand in which texts: one automaton for all of them, run where the texts lie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of strings in one automaton (about fifty bytes of memory each in a worker).
BLOCK_CHARS = 2_000_000


def _blocks(patterns: DataFrame, pattern: str) -> Iterator[list[str]]:
    """The distinct non-empty strings in blocks of bounded size."""
    distinct = patterns.select(F.col(pattern).alias("p")).where("p <> ''").distinct()
    chars = distinct.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for k in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k)
        yield sorted(r.p for r in part.collect())


def automaton(strings: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for s in strings:
        found.add_word(s, s)
    found.make_automaton()
    return found


def standing(rows: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """key, pattern: each string of ``patterns`` once for every row whose ``text`` contains it.

    Nothing is shuffled.  Null texts contain nothing, empty and null strings are
    not looked for; strings are compared as they are."""
    kind = rows.schema[key].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"{key} {kind}, {pattern} string")
    for n, strings in enumerate(_blocks(patterns, pattern)):
        shared = rows.sparkSession.sparkContext.broadcast(strings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for b in batches:
                at, said = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    hits = sorted({s for _, s in machine.iter(t)}) if t else []
                    at += [i] * len(hits)
                    said += hits
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], [key, pattern])

        part = rows.select(key, text).mapInArrow(run, out.schema)
        out = part if n == 0 else out.unionByName(part)
    return out


def present(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """pattern: the strings of ``patterns`` that some text contains; a task reports each of them once."""
    out = rows.sparkSession.createDataFrame([], f"{pattern} string")
    for n, strings in enumerate(_blocks(patterns, pattern)):
        shared = rows.sparkSession.sparkContext.broadcast(strings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine, seen = automaton(shared.value), set()
            for b in batches:
                new = {s for t in b.column(0).to_pylist() if t for _, s in machine.iter(t)} - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], [pattern])

        part = rows.select(text).mapInArrow(run, out.schema)
        out = part if n == 0 else out.unionByName(part)
    return out.distinct()
