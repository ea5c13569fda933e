"""Concepts across books: blocking, scoring, qualification, budgets."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

# Pairs of least name score and least definition score, any of which qualifies; titles that name no concept.
QUALIFY = ((0.98, 0.06), (0.78, 0.04), (0.65, 0.08), (0.55, 0.15), (0.40, 0.28))
GENERIC_TITLES = (
    "概述", "绪论", "分类", "分型", "病因", "发病机制", "病因和发病机制", "病理变化", "临床表现", "诊断", "鉴别诊断", "治疗", "预防", "预后",
    "流行病学", "实验室检查", "辅助检查", "基本概念", "一般原则", "研究进展", "疾病",
)
STRUCTURAL_TITLE = "^.+(?:概述|分类|分型|病因|发病机制|病因和发病机制|临床表现|诊断|鉴别诊断|治疗|预防|预后|实验室检查|辅助检查)$"
ALIGNED = ("core_concept", "section_topic")


class Grams(NamedTuple):
    """How a field is blocked by: characters of a gram, what a shared one weighs, most nodes that may share it, characters of the field that are read."""

    size: int
    weight: int
    most: int
    read: int | None = None


#: Names by pairs, definitions by triples of their beginning.
FIELDS = {"name": Grams(2, 3, 200), "definition": Grams(3, 1, 120, 260)}


def eligible(nodes: DataFrame, book: str, key: str) -> DataFrame:
    """Nodes that are aligned: verified, with a source, of a concrete kind, named like a concept; of one name in a book the best.

    ``nodes`` has name, definition, source_paragraph, chapter, granularity,
    evidence_status, importance and quality_score."""
    name, bare = T.clean_concept_name("name"), lambda c: F.regexp_replace(T.text(c), r"\s+", "")
    generic = F.array(*map(F.lit, GENERIC_TITLES))
    broken = T.has_broken_text("name") | T.has_broken_text("definition") | T.has_broken_text("source_paragraph")
    good = (
        F.col("granularity").isin(*ALIGNED) & (F.col("evidence_status") == "verified") & (T.text("source_paragraph") != "")
        & ~T.is_front_matter("name") & ~T.is_front_matter("chapter") & ~broken & ~T.text("name").rlike(r"\.{4,}|…{2,}|·{4,}")
        & ~F.array_contains(generic, T.normalize_name(name)) & ~name.rlike(STRUCTURAL_TITLE) & F.length(name).between(2, 30)
        & ~name.rlike("[。！？；]") & (F.regexp_count(name, F.lit("，")) < 2)
        & (F.length(bare("definition")) >= 8) & (bare("definition") != bare("name")) & (F.length(bare("source_paragraph")) >= 12)
    )
    own = Window.partitionBy(book, T.normalize_name(name)).orderBy(F.desc("importance"), F.desc("quality_score"), key)
    return nodes.where(good).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


@F.pandas_udf(t.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; null counts as empty."""
    return pd.Series([round(SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(a, b, strict=True)])


def blocks(nodes: DataFrame, key: str, book: str, fields: dict[str, Grams] = FIELDS, top: int = 10) -> DataFrame:
    """a, b, weight: for each node the ``top`` nodes of other books with most shared grams.

    A gram that more nodes have than its field allows says nothing and is not
    used, by rule, which also bounds the pairs of a gram."""
    parts = []
    for name, f in fields.items():
        read = F.substring(name, 1, f.read) if f.read else F.col(name)
        parts.append(nodes.select(F.col(key).alias("id"), F.col(book).alias("book"), F.lit(name).alias("field"), F.lit(f.weight).alias("w"), F.lit(f.most).alias("most"), F.explode(T.ngrams(read, f.size)).alias("gram")))
    grams = reduce(DataFrame.unionByName, parts)
    useful = grams.groupBy("field", "gram", "most").agg(F.count("*").alias("n")).where(F.col("n") <= F.col("most")).select("field", "gram")
    kept = grams.join(useful, ["field", "gram"])
    other = kept.select("field", "gram", F.col("id").alias("b"), F.col("book").alias("book_b"))
    pairs = kept.join(other, ["field", "gram"]).where((F.col("book") != F.col("book_b")) & (F.col("id") != F.col("b")))
    weighed = pairs.groupBy(F.col("id").alias("a"), "b").agg(F.sum("w").cast("long").alias("weight"))
    window = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    return weighed.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= top).drop("_n")


def scored(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Unordered pairs with name, definition, context and combined score, and whether they qualify.

    ``nodes`` has name, definition and chapter.  Equal names count for at least
    nine tenths; unequal ones must share a gram that is not generic."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda end: nodes.select(F.col(key).alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("name", "definition", "chapter")))
    j = one.join(side("a"), "a").join(side("b"), "b")
    name = lambda end: T.normalize_name(T.clean_concept_name(f"name_{end}"))
    j = j.withColumns({"_na": name("a"), "_nb": name("b")})
    j = j.withColumn("name_score", sequence_ratio("_na", "_nb"))
    grams = lambda c, end: T.ngrams(F.substring(f"{c}_{end}", 1, 500))
    j = j.withColumn("definition_score", F.round(T.jaccard(grams("definition", "a"), grams("definition", "b")), 4))
    j = j.withColumn("context_score", F.round(T.jaccard(grams("chapter", "a"), grams("chapter", "b")), 4))
    base = F.col("name_score") * 0.45 + F.col("definition_score") * 0.45 + F.col("context_score") * 0.10
    same = (F.col("_na") != "") & (F.col("_na") == F.col("_nb"))
    shared = F.array_except(F.array_intersect(T.ngrams("_na"), T.ngrams("_nb")), F.array(*map(F.lit, T.GENERIC_GRAMS)))
    passes = F.lit(False)
    for n, d in QUALIFY:
        passes = passes | ((F.col("name_score") >= n) & (F.col("definition_score") >= d))
    return j.select("a", "b", "name_score", "definition_score", "context_score", F.round(F.when(same, F.greatest(base, F.lit(0.9))).otherwise(base), 4).alias("score"), (passes & ((F.col("_na") == F.col("_nb")) | (F.size(shared) > 0))).alias("qualified"))


def judged(pairs: DataFrame) -> DataFrame:
    """The deterministic judgement: equal names are equivalent, all else is related, with bounded confidence."""
    equal = F.col("name_score") >= 1.0
    return pairs.withColumn("relation", F.when(equal, "equivalent_to").otherwise("related_to")).withColumn("confidence", F.when(equal, F.least(F.col("score"), F.lit(0.82))).otherwise(F.least(F.col("score"), F.lit(0.76))))


def reviewed(candidates: DataFrame, action: str = "action") -> DataFrame:
    """Status after a review: only pending and edited candidates with evidence on both sides change; else an error code."""
    open_ = F.col("status").isin("pending", "edited")
    evidence = (F.col("source_evidence") != "") & (F.col("target_evidence") != "")
    code = F.when(F.col("status").isNull(), 404).when(~open_, 409).when((F.col(action) == "approve") & ~evidence, 400).when(~F.col(action).isin("approve", "reject", "edit"), 400)
    after = F.when(code.isNotNull(), F.col("status")).when(F.col(action) == "approve", "approved").when(F.col(action) == "reject", "rejected").otherwise("edited")
    return candidates.withColumns({"new_status": after, "error": code})


def greedy_budget(rows: DataFrame, group: str, key: str, score: str, size: str, locked: str, share: float) -> DataFrame:
    """group, key, kept: locked rows, then by score each row that still fits the budget (``share`` of all sizes), skipping those that do not.

    Skipping makes the choice sequential, so a group is one task: three numbers a
    row, about a hundred bytes of memory each (ten million rows in a gigabyte)."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([locked, score, key], ascending=[False, False, True])
        left = share * f[size].sum()
        kept = []
        for n, fixed in zip(f[size], f[locked], strict=True):
            take = bool(fixed) or n <= left
            left -= n if take else 0
            kept.append(take)
        return f[[group, key]].assign(kept=kept)

    return rows.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {key} {kind[key]}, kept boolean")


def compressed(rows: DataFrame, prerequisites: DataFrame, group: str, key: str, chapter: str, score: str, size: str, locked: str, merged: str, share: float) -> DataFrame:
    """group, key, why: the nodes that stay, and for which reason (the first that holds).

    ``locked`` and ``merged`` nodes always; by score those that fit the budget; what
    kept nodes have as prerequisite (``source``, ``target``), one step back; and of
    a chapter that has nothing left the best node."""
    always = rows.withColumn("_always", F.col(locked) | F.col(merged))
    fitted = greedy_budget(always, group, key, score, size, "_always", share).where("kept").select(group, key)
    first = always.join(fitted, [group, key]).select(group, key, chapter, F.when(F.col(locked), "locked").when(F.col(merged), "merged").otherwise("budget").alias("why"))
    needed = prerequisites.join(first.select(F.col(key).alias("target")), "target", "left_semi").select(F.col("source").alias(key)).distinct()
    left = always.join(first.select(group, key), [group, key], "left_anti")
    back = left.join(needed, key, "left_semi").select(group, key, chapter, F.lit("prerequisite").alias("why"))
    kept = first.unionByName(back)
    best = Window.partitionBy(group, chapter).orderBy(F.desc(score), key)
    bare = left.join(kept.select(group, chapter), [group, chapter], "left_anti")
    last = bare.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(group, key, chapter, F.lit("chapter").alias("why"))
    return kept.unionByName(last).select(group, key, "why")
