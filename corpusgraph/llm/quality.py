"""Quality rules as weak supervision, in SQL functions only.

Each rule measures one trait of a text and votes good (1), bad (-1) or abstains
(0), between its two bounds or where it cannot tell.  Expectation maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever the
corpus) estimates how often each rule votes which way on good and on bad
documents, abstentions included, and the posterior probability of good replaces
the all-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: Where the estimates start: P(vote | good), P(vote | bad).  As pseudo-counts they weigh as WEIGHT documents.
BELIEF = {1: (0.85, 0.4), 0: (0.14, 0.3), -1: (0.01, 0.3)}
PRIOR, WEIGHT = 0.9, 20.0
#: Words in a window that counts as repeated when found twice.
WINDOW = 8


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, and n_upper, n_alpha_words, n_bangs, n_unique for the rules.

    A null or empty text counts nothing."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn(
        "windows",
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    # windows in order of their hash; equal neighbours occur twice or more
    base = base.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    base = base.withColumn(
        "twice",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, i: F.get(F.col("sorted"), i - 1)["h"].eqNullSafe(x["h"]) | F.get(F.col("sorted"), i + 1)["h"].eqNullSafe(x["h"]),
                ),
                lambda x: x["at"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform("twice", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("twice"), i + 1) - at, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    without = lambda chars: F.length(F.translate("text", chars, ""))
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        (F.length("text") - without("!")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("words")).cast("long").alias("n_unique"),
    )


def rules() -> dict[str, Column]:
    """Name of each rule and its vote, over the columns of ``statistics``; a text without words has no votes."""
    c = F.col
    n, lines, letters, chars = (F.greatest(c(x), F.lit(1)) for x in ("n_words", "n_lines", "n_letters", "word_chars"))
    mean = c("word_chars") / n
    vote = lambda good, bad: F.when(c("n_words") == 0, 0).when(good, 1).when(bad, -1).otherwise(0)
    return {
        "word_length": vote(mean.between(3.0, 9.5), (mean < 2.0) | (mean > 14.0)),
        "symbols_per_word": vote(c("n_symbols") <= 0.05 * n, c("n_symbols") > 0.2 * n),
        "symbols_per_character": vote(c("n_symbols") <= 0.02 * chars, c("n_symbols") > 0.1 * chars),
        "duplicate_lines": vote(c("n_dup_lines") <= 0.2 * lines, (c("n_lines") >= 4) & (c("n_dup_lines") > 0.5 * lines)),
        "repeats": vote(c("n_repeat_words") <= 0.1 * n, c("n_repeat_words") > 0.3 * n),
        "variety": vote((c("n_unique") >= 0.4 * n) | (c("n_unique") >= 400), (c("n_unique") < 0.2 * n) & (c("n_unique") < 200)),
        "capitals": vote((c("n_letters") > 0) & (c("n_upper") <= 0.2 * letters), c("n_upper") > 0.5 * letters),
        "letters": vote(c("n_letters") >= 0.85 * chars, c("n_letters") < 0.8 * chars),
        "shouting": vote(c("n_bangs") <= 0.1 * n, c("n_bangs") > 0.4 * n),
    }


Table = dict[int, tuple[float, float]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 1000, prior: float = PRIOR, settled: float = 1e-7) -> tuple[float, list[Table]]:
    """(share of good documents, for each rule vote -> (P(vote | good), P(vote | bad))) of vote patterns and their counts.

    Two-class expectation maximisation from PRIOR and BELIEF, until no estimate
    moves by ``settled``.  No patterns: the beliefs."""
    k = len(patterns[0][0]) if patterns else 0
    tables = [dict(BELIEF) for _ in range(k)]
    for _ in range(rounds if patterns else 0):
        good = bad = 0.0
        sums = [{v: [0.0, 0.0] for v in BELIEF} for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, prior, tables)
            good, bad = good + n * p, bad + n * (1 - p)
            for s, v in zip(sums, votes, strict=True):
                s[v][0] += n * p
                s[v][1] += n * (1 - p)
        was = prior, tables
        prior = (good + WEIGHT * PRIOR) / (good + bad + WEIGHT)
        tables = [{v: tuple((s[v][c] + WEIGHT * BELIEF[v][c]) / (total + WEIGHT) for c, total in enumerate((good, bad))) for v in BELIEF} for s in sums]
        if max(abs(prior - was[0]), *(abs(t[v][c] - o[v][c]) for t, o in zip(tables, was[1], strict=True) for v in BELIEF for c in (0, 1))) < settled:
            break
    return prior, tables


def posterior(votes: tuple[int, ...], prior: float, tables: list[Table]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(votes, tables, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The statistics of each document of ``docs`` (doc_id, text), its votes, ``quality`` (posterior
    probability of good) and ``kept`` (quality >= threshold).

    On a text without words (null, empty, blank) all rules abstain, and what that
    says is estimated like any vote.  Repeated rows are judged one by one, alike.
    An empty table gives no rows."""
    stats = written(statistics(docs), "quality")
    votes = rules()
    voted = stats.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in votes.items()))
    names = [f"vote_{k}" for k in votes]
    # at most 3 ** 9 rows, however many documents there are
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, tables = fit(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, t in zip(names, tables, strict=False):
        w = {v: math.log(t[v][0] / t[v][1]) for v in t}
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    voted = voted.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return voted.withColumn("kept", F.col("quality") >= threshold)
