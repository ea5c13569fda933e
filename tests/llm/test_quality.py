import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(8)
    sentence = lambda n: " ".join("".join(r.choice(["th", "er", "on", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(n)) + "."
    clean = [sentence(r.randrange(40, 300)) for _ in range(60)]
    line = sentence(10)
    junk = [(line + "\n") * 30, "$$$ ### " * 60, "A!! B!! C!! " * 40, "a b " * 300, " | ".join(sentence(1) for _ in range(80))]
    return [None, "", " \t\x0b", "one", "\n\n \n", "x\ny\nx\n x", *clean, *junk, sentence(20_000), sentence(5) + " " + clean[0] + " " + clean[0]]


def test_counts_match_brute_force(spark, docs):
    t = texts()
    got = {r.doc_id: r for r in quality.statistics(docs(t)).collect()}
    assert [(got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) for i in range(len(t))] == list(map(brute, t))


def test_clean_texts_stay_and_junk_goes(spark, docs):
    t = texts()
    kept = {r.doc_id: r.kept for r in quality.judge(docs(t)).collect()}
    assert all(kept[i] for i in range(6, 66)) and not any(kept[i] for i in range(66, 70))


def test_estimates_recover_accuracies():
    """Rules that trip on one kind of junk each, and one that knows prose.

    Kinds that exclude one another are not independent, as the model has it, and
    silence of the one strong rule is taken for junk; verdicts still beat keeping all."""
    r = random.Random(1)
    patterns, truth = Counter(), []
    for _ in range(4000):
        kind = r.choice([0, 1, 2, 3]) if r.random() < 0.2 else None
        votes = [-1 if r.random() < (0.9 if kind == k else 0.01) else 0 for k in range(4)]
        votes.append(1 if r.random() < (0.9 if kind is None else 0.02) else 0)
        patterns[tuple(votes)] += 1
        truth.append((tuple(votes), kind is None))
    prior, tables = quality.fit(sorted(patterns.items()))
    right = sum((quality.posterior(v, prior, tables) >= 0.5) == g for v, g in truth) / len(truth)
    assert 0.65 < prior < 0.85 and right > 0.9 and tables[4][1][0] > 0.8
    assert not any(quality.posterior(tuple(-1 if i == k else 0 for i in range(5)), prior, tables) >= 0.5 for k in range(4))


RATES = {
    "weak": [({1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.2, 0: 0.4, -1: 0.4})] * 7,
    "alike": [({1: 0.8, 0: 0.15, -1: 0.05}, {1: 0.5, 0: 0.2, -1: 0.3})] * 8,
    "mixed": [({1: 0.9, 0: 0.08, -1: 0.02}, {1: 0.3, 0: 0.1, -1: 0.6})] * 3 + [({1: 0.0, 0: 0.97, -1: 0.03}, {1: 0.0, 0: 0.6, -1: 0.4})] * 4,
    "silent": [({1: 0.7, 0: 0.29, -1: 0.01}, {1: 0.05, 0: 0.6, -1: 0.35})] * 8,
}


def rows_of(rates, share, n=40_000):
    r = np.random.default_rng(5)
    good = r.random(n) < share
    p = np.array([[[t[v] for v in (1, 0, -1)] for t in rule] for rule in rates])
    votes = [np.where(good, r.choice([1, 0, -1], n, p=rule[0]), r.choice([1, 0, -1], n, p=rule[1])) for rule in p]
    return np.stack(votes, axis=1), good


@pytest.mark.parametrize("name", RATES)
@pytest.mark.parametrize("share", [0.6, 0.8, 0.95])
def test_prior_rates_and_verdicts(name, share):
    """On votes made from known rates: share and rates come out, and verdicts beat keeping everything."""
    votes, good = rows_of(RATES[name], share)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    prior, tables = quality.fit(patterns)
    known = {v: quality.posterior(v, prior, tables) >= 0.5 for v, _ in patterns}
    right = np.mean([known[v] == g for v, g in zip(map(tuple, votes.tolist()), good.tolist())])
    assert abs(prior - share) < 0.05 and right > share
    assert all(abs(t[v][c] - rule[c][v]) < 0.05 for t, rule in zip(tables, RATES[name]) for v in (1, 0, -1) for c in (0, 1))


def test_estimates_match_plain_expectation_maximisation():
    """The same algorithm row by row, in other words: one weight a document, tables from weighted counts."""
    votes, _ = rows_of(RATES["mixed"], 0.7, 3000)
    start = np.array([quality.BELIEF[v] for v in (1, 0, -1)])
    hot = np.stack([votes == v for v in (1, 0, -1)], axis=2).astype(float)  # row, rule, vote
    prior, table = quality.PRIOR, np.repeat(start[None], votes.shape[1], 0)  # rule, vote, class
    for _ in range(500):
        like = np.exp(np.einsum("nrv,rvc->nc", hot, np.log(table))) * [prior, 1 - prior]
        p = like / like.sum(axis=1, keepdims=True)
        prior = (p[:, 0].sum() + quality.WEIGHT * quality.PRIOR) / (len(p) + quality.WEIGHT)
        table = (np.einsum("nrv,nc->rvc", hot, p) + quality.WEIGHT * start) / (p.sum(axis=0) + quality.WEIGHT)
    got, tables = quality.fit(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(got - prior) < 1e-4
    assert all(abs(t[v][c] - table[i, k, c]) < 1e-4 for i, t in enumerate(tables) for k, v in enumerate((1, 0, -1)) for c in (0, 1))


def test_labelled_junk_goes_and_the_rest_stays(spark):
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("needs the test tables")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept")
    kept = {r["quality"]: r["share"] for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.05


def test_empty(spark, docs):
    assert quality.judge(docs(["x"]).limit(0)).collect() == []
