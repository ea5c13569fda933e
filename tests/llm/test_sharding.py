import zlib
from collections import Counter

from corpusgraph.llm import sharding


def check(rows, texts, n):
    total = len(texts)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(n)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_counts_slots_and_mixture(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    texts = [None, "", "é" * 9, *(f"text {i}" for i in range(900)), *["copy"] * 97]
    rows = sharding.shard_rows(docs(texts), n_shards=8).collect()
    check(rows, texts, 8)
    whole = Counter(r.source for r in rows)
    for s in range(8):
        part = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(part[k] - whole[k] / 8) <= 2 for k in whole)
    again = sharding.shard_rows(docs(texts).repartition(5), n_shards=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_small_empty_and_repeated(spark, docs):
    check(sharding.shard_rows(docs(["a", "b", None]), n_shards=40).collect(), ["a", "b", None], 40)
    assert sharding.shard_rows(docs(["a"]).limit(0)).collect() == []
    twice = docs(["a", "a"]).union(docs(["a", "a"]))
    assert sorted(r.shard for r in sharding.shard_rows(twice, n_shards=4).collect()) == [0, 1, 2, 3]


def test_crowds_of_equal_rows_and_null_ids(spark, docs, monkeypatch):
    """One id, or none, in hundreds of equal rows: their bucket is dealt anew, and shards stay equal."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    from pyspark.sql import functions as F

    d = docs(["same"] * 900 + [f"t{i}" for i in range(300)]).withColumn("doc_id", F.when(F.col("doc_id") < 900, None).otherwise(F.col("doc_id"))).withColumn("source", F.lit("one"))
    rows = sharding.shard_rows(d, n_shards=7).collect()
    sizes = Counter(r.shard for r in rows)
    assert sum(sizes.values()) == 1200 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    same = Counter(r.shard for r in rows if r.doc_id is None)
    assert all(abs(same[s] - 900 / 7) < 40 for s in sizes)


def test_many_sources_of_one_row(spark, monkeypatch):
    """They spread over the shards, and no cell holds many."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    d = spark.createDataFrame([(i, f"t{i}", f"own{i}" if i < 1500 else "big") for i in range(2000)], "doc_id long, text string, source string")
    rows = sharding.shard_rows(d, n_shards=10).collect()
    alone = Counter(r.shard for r in rows if r.source != "big")
    assert all(100 < alone[s] < 200 for s in range(10))
    cells = Counter(int(r.fraction * 128) for r in rows)
    assert max(cells.values()) < 60


def test_matches_a_plain_ranking(spark, docs):
    """The same places as ranks counted in memory, source by source and then over all."""
    import hashlib

    texts = [f"text {i}" for i in range(500)]
    rows = sharding.shard_rows(docs(texts), n_shards=6, seed=3).collect()
    part = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16) / 2.0**52
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((hashlib.md5(f"3:{r.doc_id}:{r.text_crc32}:{r.size}".encode()).hexdigest(), r.doc_id))
    order = sorted(((k + 1 - part(f"3:source:{s}")) / len(ids), s, h, i) for s, ids in by.items() for k, (h, i) in enumerate(sorted(ids)))
    n = len(order)
    want = {i: (p * 6 // n, p - -(-(p * 6 // n) * n // 6)) for p, (*_, i) in enumerate(order)}
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
