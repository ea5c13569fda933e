"""Questions against passages: preparation, gate, features, ranking and fusion, each with its SQL.

Binding: a benchmark item is a question, a document a passage; its language is the
book, its source the chapter and the section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import questions as Q
from ..session import settled
from ..sources import tables as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def passages(spark, sf_dir) -> DataFrame:
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("book"), F.col("source").alias("chapter"), F.array("source").alias("path"), F.col("doc_id").cast("long").alias("chunk_index"), F.col("text").alias("content"))


def asked(spark, sf_dir) -> DataFrame:
    return Q.prepared(S.table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text", {})


_STOP = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
_ASKED = rf"""q AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]+'), lambda x: NOT list_contains([{_STOP}], x)) AS words FROM benchmark),
  p AS (SELECT item_id, words, list_filter(words, lambda x: length(x) >= 4) AS lw, words[:3] AS topics, coalesce(words[1], '') AS first FROM q)"""

# the same in words of SQL: passages that share a word, the gate, the section of the primary subject, the features
_RANKED = rf"""WITH {_ASKED},
  t AS (SELECT doc_id, lang, source, text, lang || ' ' || source || chr(10) || text AS whole FROM documents),
  dt AS (SELECT doc_id, regexp_extract_all(lower(whole), '[a-z0-9]+') AS toks FROM t), len AS (SELECT doc_id, len(toks) AS dl FROM dt), st AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM len),
  tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  raw AS (SELECT token, ln(N - df + 0.5) - ln(df + 0.5) AS w FROM df, st), idf AS (SELECT token, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw),
  qt AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(words) AS token FROM p) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN len USING (doc_id), st GROUP BY ALL),
  said AS (SELECT doc_id, regexp_extract_all(lower(whole), '[a-z][a-z0-9-]+') AS said FROM t),
  g AS (SELECT item_id, doc_id, score, words, topics, first, list_distinct(lw) AS a, list_intersect(list_distinct(lw), said) AS b, lw, said FROM s JOIN p USING (item_id) JOIN said USING (doc_id) WHERE score > 0),
  ok AS (SELECT *, CASE WHEN len(a) = 0 THEN false WHEN len(a) = 1 THEN len(b) = 1 ELSE
      len(list_filter(range(1, len(lw)), lambda i: contains(array_to_string(said, ' '), lw[i] || ' ' || lw[i + 1]))) > 0
      OR (len(b) * 5 >= 3 * len(a) AND len(list_filter(b, lambda x: length(x) >= 7)) > 0) END AS ok FROM g),
  m AS (SELECT ok.*, t.lang, t.source, t.text, t.whole, ok AND length(first) >= 4 AND list_contains(said, first) AS main FROM ok JOIN t USING (doc_id)),
  n AS (SELECT *, bool_or(ok) OVER (PARTITION BY item_id) AS any_ok, bool_or(main) OVER (PARTITION BY item_id) AS any_main,
    bool_or(main) OVER (PARTITION BY item_id, lang, source ORDER BY doc_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m),
  c AS (SELECT *, list_distinct(list_transform(range(1, length(first)), lambda i: substr(first, i, 2))) AS grams, lower(regexp_replace(whole, '\s+', '', 'g')) AS w, lower(regexp_replace(text, '\s+', '', 'g')) AS body, lower(source) AS sec,
    list_filter(topics, lambda x: length(x) >= 2) AS tops, list_distinct(list_filter(words, lambda x: length(x) >= 2)) AS anchors FROM n WHERE any_ok AND CASE WHEN any_main THEN near ELSE ok END),
  f AS (SELECT *, len(list_filter(grams, lambda x: contains(w, x))) / greatest(len(grams), 1) AS topic, len(list_filter(grams, lambda x: contains(sec, x))) / greatest(len(grams), 1) AS section_topic,
    greatest(len(list_filter(grams, lambda x: contains(body, x))), len(list_filter(grams, lambda x: contains(sec, x)))) / greatest(len(grams), 1) AS own,
    len(list_filter(tops, lambda x: contains(w, x))) / greatest(len(tops), 1) AS all_topic, len(list_filter(tops, lambda x: contains(sec, x))) / greatest(len(tops), 1) AS section_exact,
    coalesce(list_sum(list_transform(list_filter(anchors, lambda x: contains(w, x)), lambda x: least(length(x), 8) * least(length(x), 8))), 0)::BIGINT AS anchor, first <> '' AND contains(sec, first) AS tail FROM c),
  r AS (SELECT *, CASE WHEN max(own) OVER (PARTITION BY item_id, lang, source ORDER BY doc_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 0.75 THEN 1.0 ELSE own END AS subject,
    round(0.46 * score / max(score) OVER (PARTITION BY item_id) + 0.12 * topic + 0.16 * section_topic + 0.08 * section_exact + 0.12 * all_topic
      + 0.02 * anchor / CASE WHEN max(anchor) OVER (PARTITION BY item_id) = 0 THEN 1 ELSE max(anchor) OVER (PARTITION BY item_id) END, 6) AS final FROM f),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, score DESC, tail DESC, doc_id) AS rank FROM r)"""


@query(f"WITH {_ASKED} SELECT item_id, array_to_string(words, ' ') AS tokens, array_to_string(topics, ' ') AS topics, length(first) >= 3 AS single FROM p")
def question_parts(spark, sf_dir):
    """What every question is about."""
    return asked(spark, sf_dir).select("item_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("topics", " ").alias("topics"), F.col("primary").alias("single"))


@query(f"{_RANKED} SELECT item_id, count(*) AS n, sum(doc_id)::BIGINT AS docs, round(sum(score), 3) AS score FROM c GROUP BY item_id")
def question_candidates(spark, sf_dir):
    """How many passages pass the gate of each question."""
    got = Q.reached(asked(spark, sf_dir), passages(spark, sf_dir), "item_id", "doc_id")
    return got.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("docs"), F.round(F.sum("score"), 3).alias("score"))


@query(f"""{_RANKED} SELECT item_id, doc_id, score, round(topic, 6) AS topic, round(section_topic, 6) AS section_topic, round(all_topic, 6) AS all_topic, round(section_exact, 6) AS section_exact, anchor,
  round(subject, 6) AS subject, final, rank FROM ranked WHERE rank <= 20""")
def question_ranking(spark, sf_dir):
    """The twenty best passages of every question, with their features."""
    got = Q.ranked(asked(spark, sf_dir), passages(spark, sf_dir), "item_id", "doc_id", 20)
    six = [F.round(c, 6).alias(c) for c in ("topic", "section_topic", "all_topic", "section_exact")]
    return got.select("item_id", "doc_id", "score", *six, "anchor", F.round("subject", 6).alias("subject"), "final", F.col("rank").cast("long").alias("rank"))


@query(f"""{_RANKED}, answered AS (SELECT DISTINCT item_id FROM ranked),
  gr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20)),
  u AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS part FROM ranked WHERE rank <= 60 UNION ALL SELECT item_id, doc_id, 0.05 / (60 + rank) FROM gr WHERE rank <= 60 AND item_id NOT IN (FROM answered))
  SELECT item_id, doc_id, round(sum(part), 8) AS fused, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(part), 8) DESC, doc_id) AS rank FROM u SEMI JOIN (SELECT item_id, doc_id FROM ok WHERE ok) USING (item_id, doc_id) GROUP BY item_id, doc_id""")
def hybrid_ranking(spark, sf_dir):
    """Lexical and graph rankings as one; the graph speaks only where no passage passes the gate, and what it says is gated too."""
    q, p = asked(spark, sf_dir), passages(spark, sf_dir)
    d, b = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark")
    lexical = settled(Q.ranked(q, p, "item_id", "doc_id"))
    by = Window.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id")
    graph = b.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")).join(d.select("doc_id", "source", "n_chars"), "source")
    graph = graph.withColumn("rank", F.row_number().over(by)).where("rank <= 60")
    said = lexical.select("item_id", "doc_id").unionByName(graph.select("item_id", "doc_id"))
    got = Q.hybrid({"bm25": lexical, "graph": graph}, "item_id", "doc_id", Q.gated(q, p, said, "item_id", "doc_id"))
    return got.select("item_id", "doc_id", "fused", F.col("rank").cast("long").alias("rank"))
