import os
import random

import numpy as np
import pytest

from corpusgraph.llm import bwt, repeats


def test_collection_matches_sorted_suffixes():
    r = random.Random(2)
    for _ in range(15):
        texts = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 14))) for _ in range(40)]
        width = max(map(len, texts))
        rows = np.zeros((40, width), np.uint8)
        for i, t in enumerate(texts):
            rows[i, width - len(t) :] = np.frombuffer(t, np.uint8)
        b, lcp, who, size = bwt.collection(rows, np.array([len(t) for t in texts]))
        suffixes = sorted(((*t[k:], i - 1000), i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert [(i, len(texts[i]) - k) for _, i, k in suffixes] == list(zip(who.tolist(), size.tolist()))
        assert b.tolist() == [texts[i][k - 1] if k else 0 for _, i, k in suffixes]
        plain = [texts[i][k:] for _, i, k in suffixes]
        assert lcp.tolist() == [0] + [len(os.path.commonprefix([x, y])) for x, y in zip(plain, plain[1:])]


def brute(rows, w=50):
    seen = {}
    for i, t in rows:
        for p in range(len(t) - w + 1):
            s = t[p : p + w]
            seen[s] = min(i, seen.get(s, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - w + 1):
            if seen[t[p : p + w]] < i:
                gone[p : p + w] = b"\1" * w
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            z = gone.find(0, a)
            at = z if z >= 0 else len(t)
            spans.append((a, at))
        out.append((i, len(t), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "ing", " "]) for _ in range(3))
    long = lambda n: " ".join(word() for _ in range(n))
    line = long(12)
    out = [None, "", "short", "x" * 49, "x" * 50, "x" * 50, "y" * 700, "y" * 300, "\0" * 60 + "a", "\0" * 70]
    base = [long(60) for _ in range(12)]
    out += base + base[:4]
    for b in base:
        ws = b.split(" ")
        ws[r.randrange(len(ws))] = "changed"
        out.append(" ".join(ws))
        out.append(long(5) + line + long(5) + b[100:160])
    out.append(long(4000) + base[0])
    return out


@pytest.mark.parametrize(("size", "hot"), [(4_000_000, 50), (3_000, 50), (3_000, 2)])
def test_matches_brute_force(spark, docs, size, hot):
    """In one block, in many, and with minimizers so common that windows are dealt one by one."""
    t = texts()
    d = docs(t).union(docs(["x" * 50, "dup " * 40, "dup " * 40], start=4))
    got = repeats.remove_repeats(d, block_bytes=size, hot_blocks=hot).collect()
    mine = sorted((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in got)
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    assert mine == brute(rows)
    assert sum(bool(x[2]) for x in mine) > 15


def test_null_ids_and_empty(spark, docs):
    from pyspark.sql import functions as F

    d = docs(["a" * 60, "a" * 60]).withColumn("doc_id", F.when(F.col("doc_id") == 1, 7))
    got = {r.doc_id: len(r.kept) for r in repeats.remove_repeats(d).collect()}
    assert got == {None: 0, 7: 60}
    assert repeats.remove_repeats(d.limit(0)).collect() == []


def test_largest_id_and_many_blocks(spark, docs, monkeypatch):
    """The largest long is an id of its own; blocks beyond STEADY_BLOCKS grow, and files of the table stay few."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(repeats, "STEADY_BLOCKS", 2)
    monkeypatch.setattr(repeats, "MOST_FILES", 3)
    t = texts()
    d = docs(t).withColumn("doc_id", F.when(F.col("doc_id") == len(t) - 1, F.lit(2**63 - 1)).otherwise(F.col("doc_id")))
    got = repeats.remove_repeats(d, block_bytes=2_000).collect()
    mine = sorted((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in got)
    assert mine == brute([(r.doc_id, (r.text or "").encode()) for r in d.collect()]) and mine[-1][0] == 2**63 - 1
