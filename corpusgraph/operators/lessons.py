"""Lessons made of evidence: how passages introduce a topic, artifacts without a model, commands carried out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

# What numbers a heading, what marks exercises, what a heading about a topic may go on with; bonuses.
NUMBERING = r"^(?:第[一二三四五六七八九十百零〇\d]+[章节篇部]|[（(]?[一二三四五六七八九十百零〇\d]+[）).．、]|[ivxlcdm]+[.、])"
TRANSLATION = r"[（(]?[a-z][a-z0-9,\-/()（）]*[）)]?"
BREAKS = r"[。；，,:：!?！？、与和及]"
FACET = r"[一-鿿a-z0-9（）()\-]+"
EXERCISE = r"操作|习题|练习|实训|实验步骤|实验方法|实验流程|实验操作|exercises?|procedures?"
EXACT, SCOPED, FADE, OPENS, OPENS_SCOPED, AUXILIARY = 1.2, 0.8, 0.35, 1.8, 1.4, 1.4
STEPS, EXPLAINED = 48, 320
LOCKED_OPERATIONS = ("split", "remove")


def _bare(value: str) -> str:
    return re.sub(r"\s+", "", value or "").lower()


def names_topic(heading: str, topic: str) -> str:
    """"exact" if a heading is the topic (numbering and a translation aside), "scoped" if it is a facet of it, else ""."""
    h = re.sub(NUMBERING, "", _bare(heading)).lstrip("|｜:：、.． ")
    if not h.startswith(topic):
        return ""
    rest = h[len(topic) :]
    if not rest or re.fullmatch(TRANSLATION, rest):
        return "exact"
    return "scoped" if len(rest) <= 18 and not re.search(BREAKS, rest) and re.fullmatch(FACET, h) else ""


def introduces(topic: str, labels: list[str], content: str, query: str) -> float:
    """What a passage gains for introducing a topic that is asked for alone: by the headings above it, by its first lines, less for exercises."""
    topic = _bare(topic)
    kinds = [names_topic(x, topic) for x in labels]
    near = lambda kind, worth: max((worth / (1 + (len(labels) - 1 - i) * FADE) for i, k in enumerate(kinds) if k == kind), default=0.0)
    path = max(near("exact", EXACT), near("scoped", SCOPED), near("exact", SCOPED))
    first = [line.strip() for line in (content or "")[:400].splitlines() if line.strip()][:8]
    opening = OPENS if any(names_topic(x, topic) == "exact" for x in first) else OPENS_SCOPED if first and names_topic(first[0], topic) == "scoped" else 0.0
    aside = re.search(EXERCISE, " ".join(labels), re.I) and not re.search(EXERCISE, query or "", re.I)
    return path + opening - (AUXILIARY if aside else 0.0)


@F.pandas_udf(t.DoubleType())
def introduction_bonus(query: pd.Series, anchors: pd.Series, labels: pd.Series, content: pd.Series) -> pd.Series:
    """``introduces`` for questions that are one literal topic; 0 for all others."""
    out = []
    for q, a, x, c in zip(query, anchors, labels, content, strict=True):
        names = [] if a is None else list(a)
        single = len(names) == 1 and _bare(q) == _bare(names[0])
        out.append(introduces(names[0], [str(v or "") for v in (x if x is not None else [])], c, q) if single else 0.0)
    return pd.Series(out)


def bridge(ranked: DataFrame, query: str, key: str, literal: str = "literal", bonus: str = "bonus") -> DataFrame:
    """Passages of each question and book by the reciprocal of their lexical rank (null: none), literal topics and introductions; one of equal texts.

    ``ranked``: query, book, key, content, lexical_rank, literal, bonus, chunk_index."""
    score = F.coalesce(1.0 / F.col("lexical_rank"), F.lit(0.0)) + F.col(literal) * 0.04 + F.col(bonus)
    order = [F.desc("bridge_score"), F.coalesce("chunk_index", F.lit(0)), F.col(key)]
    scored = ranked.withColumn("bridge_score", F.round(score, 6))
    same = Window.partitionBy(query, "book", F.sha2(T.normalize_evidence("content"), 256)).orderBy(*order)
    once = scored.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(query, "book").orderBy(*order)))


def literal_score(anchors: Column, content: Column) -> Column:
    """Characters (twenty at most for each) of the anchors that stand in a passage."""
    said = T.normalize_evidence(content)
    return F.aggregate(F.filter(anchors, lambda a: said.contains(T.normalize_evidence(a))), F.lit(0), lambda n, a: n + F.least(F.length(a), F.lit(20)))


def evidence_steps(items: DataFrame, topic: str, rank: str, path: str, chapter: str, content: str) -> DataFrame:
    """topic, step, title, explanation, source_id: the first STEPS passages as steps of a lesson, where no model answers."""
    last = F.element_at(F.when(F.size(path) > 0, F.col(path)), -1)
    name = F.coalesce(last, F.when(T.text(chapter) != "", F.col(chapter)), F.concat(F.lit("证据 "), F.col(rank).cast("string")))
    return items.where(F.col(rank) <= STEPS).select(topic, F.col(rank).alias("step"), name.alias("title"), F.substring(T.text(content), 1, EXPLAINED).alias("explanation"), F.concat(F.lit("S"), F.col(rank).cast("string")).alias("source_id"))


def commands_applied(decisions: DataFrame, commands: DataFrame, order: str) -> DataFrame:
    """Decisions after commands: ``split`` and ``remove`` change the one they name (the last command counts), ``merge`` makes a new one.

    ``decisions``: id, action, result_name, confidence, teacher_override, feedback;
    ``commands``: id (of the command), operation, decision_id, targets, message.
    A command that names no decision changes none."""
    last = Window.partitionBy("decision_id").orderBy(F.desc(order))
    told = commands.where(F.col("operation").isin(*LOCKED_OPERATIONS) & F.col("decision_id").isNotNull()).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    told = told.select(F.col("decision_id").alias("id"), F.col("operation").alias("_op"), F.col("message").alias("_said"))
    hit = F.col("_op").isNotNull()
    changed = decisions.join(told, "id", "left").select(
        "id", F.coalesce("_op", "action").alias("action"), "result_name", "confidence", (F.coalesce("teacher_override", F.lit(False)) | hit).alias("teacher_override"), F.coalesce("_said", "feedback").alias("feedback"),
    )
    merged = commands.where((F.col("operation") == "merge") & (F.size("targets") > 0)).select(
        F.concat(F.lit("dec_teacher_"), F.col("id").cast("string")).alias("id"), F.lit("merge").alias("action"), F.array_join("targets", " + ").alias("result_name"), F.lit(1.0).alias("confidence"), F.lit(True).alias("teacher_override"), F.col("message").alias("feedback"),
    )
    return changed.unionByName(merged)


def locked_by(nodes: DataFrame, commands: DataFrame, key: str, name: str) -> DataFrame:
    """key of the nodes that ``keep`` commands lock: a target stands in their name, ASCII case aside."""
    from .matching import standing

    asked = commands.where("operation = 'keep'").select(F.explode("targets").alias("_t")).select(F.lower("_t").alias("_t"))
    return standing(nodes.select(key, F.lower(T.text(name)).alias("_name")), key, "_name", asked, "_t").select(key).distinct()


def shown(label: Column, kind: Column) -> Column:
    """Whether a node is drawn: sections and core concepts whose label reads as a name, not as a measure or a sentence."""
    c = T.blank_runs(label)
    measure = c.rlike(r"^(?i:[0-9]+(?:[.,\s~-]+[0-9]+)*\s*(?:cm|mm|kg|g|元|页|年|月|日)?[。，]?)$")
    bare = F.regexp_replace(F.regexp_replace(c, r"^(?:第[一二三四五六七八九十百〇零两0-9]+节|[一二三四五六七八九十]+[、.．]|[0-9]+[、.．])\s*(?=.{2,26}$)", ""), r"[。；：].*$", "")
    section = F.length(F.trim(bare)).between(2, 24) & ~bare.rlike(r"(?i:cm|mm|kg|[0-9]{2,})")
    sentence = c.rlike("[。；：、]") | c.rlike("^(?:本章|临床|注意|可能|应当|应该|此|该|或|对|以|有助于|出现|诊断为|个月)") | c.rlike("(?:可发生|可能引起|注意勿|注意不要|受到损伤|易受损伤|患有|提示为|的病|疾病的)$") | c.rlike("^(?:临床病|不是病|流行病)$")
    return F.length(c).between(2, 60) & ~measure & F.when(kind == "section_topic", section).when(kind == "core_concept", (F.length(c) <= 22) & ~sentence).otherwise(False)
