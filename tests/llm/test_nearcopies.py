import random
import re

import pytest

import corpus_pipeline as P
from corpusgraph.llm import nearcopies


def sets(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(texts):
    root = list(range(len(texts)))
    s = [sets(x) for x in texts]
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] == s[j] or 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def texts():
    r = random.Random(9)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    out, line = [None, "", " \n", "one two", "One two", "one two three"], " ".join(text(30))
    for _ in range(30):
        ws = text(r.choice([60, 150, 400]))
        out += [" ".join(ws), " ".join(ws[:20]) + " " + line]
        for share in (60, 40, 25):  # one word in so many is another
            near = list(ws)
            for k in r.sample(range(len(ws)), max(1, len(ws) // share)):
                near[k] = "other"
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("large", [64, 2])
def test_near_copies_match_brute_force(spark, docs, large):
    """Also where keys are too large to pair at once."""
    t = texts()
    want = brute(t)
    got = nearcopies.drop(docs(t), large, 1)
    assert got.columns == docs(t).columns
    assert sorted(x.doc_id for x in got.collect()) == [i for i, x in enumerate(want) if x == i]


def test_stage_drops_planted_near_copies(spark, docs):
    t = texts()
    want = brute(t)
    assert sum(x != i for i, x in enumerate(want)) > 30
    assert sorted(x.doc_id for x in P.drop_near_copies(spark, docs(t), "").collect()) == [i for i, x in enumerate(want) if x == i]


def test_texts_apart_are_compared_where_their_key_lies():
    """Pairs of a large key that sketches rule out leave no row; what is alike leaves one row for each join wanted, and all rows at the end."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 63, 100, np.uint64)
    near = [np.unique(np.append(common[1:], r.integers(0, 1 << 63, 1, np.uint64))) for _ in range(40)]
    other = [np.unique(r.integers(0, 1 << 63, k, np.uint64)) for k in range(95, 125)]

    def rows(sets, roots):
        n = len(sets)
        return pa.RecordBatch.from_arrays(
            [pa.array([7] * n), pa.array(range(n)), pa.array([len(x) for x in sets], pa.int32()), pa.array([3] * n, pa.int32()), pa.array(roots), pa.array([nearcopies._sketch(x) for x in sets], pa.binary())],
            ["key", "node", "n", "place", "root", "sketch"],
        )

    count = lambda sets, roots, spanning: sum(b.num_rows for b in nearcopies._apart(spanning)(iter([rows(sets, roots)])))
    assert [count(other, list(range(30)), s) for s in (0, 1, None)] == [0, 0, 0]
    halves = [k % 2 for k in range(40)]
    assert [count(near, halves, s) for s in (0, 1, None)] == [1, 1, 400]
    # an end of every pair is in the smaller component; pairs of single texts come once
    assert count(near[:3] + other, [0, 1, 2, *range(3, 33)], None) == 3
