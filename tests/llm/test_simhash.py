import random
import re

import numpy as np
import pytest
import xxhash

from corpusgraph.llm import simhash
from corpusgraph.llm.components import components


def brute_fp(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def texts():
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(300)}" for _ in range(r.choice([2, 5, 40, 400]))) for _ in range(60)]
    out = [None, "", " \t\n", "one", "One", "two words", "é É ÀB\x0bc d", *base, *base[:5]]
    for b in base:
        ws = b.split()
        if len(ws) > 300:
            for _ in range(3):
                ws[r.randrange(len(ws))] = "new"
                out.append(" ".join(ws).upper())
    return [*out, "long " * 70_000]


def test_fingerprints_and_groups_match_brute_force(spark, docs):
    t = texts()
    fps = [brute_fp(x) for x in t]
    got = {r.doc_id: r for r in simhash.groups(docs(t)).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(len(t))] == fps
    assert [got[i].component_id for i in range(len(t))] == brute_groups(fps)
    assert max(np.bincount(brute_groups(fps))) > 2


@pytest.mark.parametrize("large", [2048, 3])
def test_links_of_dense_groups(spark, large):
    """Also where buckets are too large to compare: the same components."""
    r = random.Random(5)
    fps = sorted({c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in [r.getrandbits(64) for _ in range(4)] for _ in range(60)} | {0})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    rows = components(simhash.links(frame, large=large)).collect()
    root = {x.node & (2**64 - 1): x.root & (2**64 - 1) for x in rows}
    want = brute_groups(fps)
    mine = [root.get(f, f) for f in fps]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_components_of_a_long_chain(spark):
    rows = components(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")).collect()
    assert len({x.root for x in rows if x.node < 900}) == 1 and len(rows) == 303


def test_empty(spark, docs):
    assert simhash.groups(docs(["x"]).limit(0)).collect() == []


def test_bit_counts_over_many_blocks():
    h = np.random.default_rng(1).integers(0, 2**63, 70_001, dtype=np.uint64)
    want = [(int(((h >> np.uint64(63 - b)) & np.uint64(1)).sum())) for b in range(64)]
    assert simhash._bit_counts(h).tolist() == want


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    """Long chains, stars and loops, with null ends, contracted in rounds or joined by one task."""
    from corpusgraph.llm import components as C

    rows = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(300, 300), (None, 5), (7, None), (-5, -6)]
    d = spark.createDataFrame(rows, "a long, b long")
    for few in (10_000, 5, 0):
        monkeypatch.setattr(C, "FEW", few)
        got = {r.node: r.root for r in C.components(d).collect()}
        groups = {}
        for node, root in got.items():
            groups.setdefault(root, set()).add(node)
        assert sorted(map(sorted, groups.values())) == [[-6, -5], list(range(1, 41)), list(range(100, 140))] and all(root in g for root, g in groups.items())
    assert C.components(d.limit(0)).count() == 0
