"""Suites of questions, streams of changes and lessons made of evidence, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import lessons as L
from ..session import shared_folder
from ..sources import tables as S
from ..streaming import jobs as J
from .textual import _BM25, _lexical

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_JUDGED = rf"""{_BM25},
  words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{6,}}') AS w FROM benchmark),
  ask AS (SELECT item_id, item_id % 5 <> 0 AS answerable, item_id % 2 = 0 AS compared, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) ELSE '' END AS ch, list_filter(w, lambda x, i: list_position(w, x) = i)[:4] AS terms FROM words),
  need AS (SELECT *, CASE WHEN len(terms) <= 2 THEN len(terms) ELSE greatest(2, (len(terms) * 3 + 4) // 5) END AS need FROM ask),
  r AS (SELECT item_id, rank, lang, source = ch AS inside, doc_id % 7 > 0 AS paged, list_filter(terms, lambda t: contains(lower(regexp_replace(text, '\s+', '', 'g')), t)) AS hit, ch FROM bm JOIN documents USING (doc_id) JOIN need USING (item_id) WHERE rank <= 8),
  per AS (SELECT item_id, count(*) AS n_shown, len(list_distinct(flatten(list(hit)))) AS covered, coalesce(len(list_distinct(flatten(list(hit) FILTER (inside)))), 0) AS covered_in, count(DISTINCT lang) FILTER (len(hit) > 0) AS n_books,
    count(*) FILTER (rank <= 3 AND paged AND len(hit) > 0 AND (ch = '' OR inside)) AS good, count(*) FILTER (rank <= 3) AS cited FROM r GROUP BY item_id),
  j AS (SELECT need.*, coalesce(n_shown, 0) AS n_shown, coalesce(covered, 0) AS covered, coalesce(covered_in, 0) AS covered_in, coalesce(n_books, 0) AS n_books, coalesce(good, 0) AS good, coalesce(cited, 0) AS cited FROM need LEFT JOIN per USING (item_id)),
  f AS (SELECT *, covered >= need AND (ch = '' OR covered_in >= need) AS hit, covered_in >= need AS ch_hit FROM j)"""


def _suite(spark, sf_dir):
    b, d = S.table(spark, sf_dir, "benchmark"), S.table(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    k = F.col("item_id")
    questions = b.select(
        "item_id", (k % 5 != 0).alias("answerable"), F.when(k % 2 == 0, "compare").otherwise("all").alias("mode"), F.lit(None).cast(E.CONCEPTS).alias("concepts"), F.slice(words, 1, 4).alias("terms"),
        F.when(k % 3 == 0, F.concat(F.lit("src"), (k % 20).cast("string"))).otherwise("").alias("chapter_id"), F.lit(None).cast("string").alias("chapter_title"), F.lit(2).alias("min_books"),
    )
    ranked = _lexical(spark, sf_dir, 8).select("item_id", "doc_id", "rank").join(d, "doc_id")
    page = F.col("doc_id") % 7
    results = ranked.select("item_id", "rank", F.col("doc_id").alias("id"), F.col("lang").alias("book"), F.col("source").alias("chapter_id"), F.lit("").alias("chapter"), F.col("text").alias("content"), F.array().cast("array<string>").alias("path"), page.alias("page_start"), (page + 1).alias("page_end"))
    return E.judged(questions, results, "item_id")


@query(f"""WITH {_JUDGED} SELECT * FROM (SELECT unnest(['retrieval_recall', 'citation_precision', 'cross_book_coverage', 'refusal', 'chapter_question_hit', 'chapter_coverage']) AS metric,
    unnest([n1, n2, n3, n4, n5, n6])::BIGINT AS numerator, unnest([d1, d2, d3, d4, d5, d6])::BIGINT AS denominator, coalesce(round(unnest([n1, n2, n3, n4, n5, n6]) / nullif(unnest([d1, d2, d3, d4, d5, d6]), 0), 4), 0.0) AS ratio
  FROM (SELECT count(*) FILTER (answerable AND hit) AS n1, count(*) FILTER (answerable) AS d1, coalesce(sum(good) FILTER (answerable), 0) AS n2, coalesce(sum(cited) FILTER (answerable), 0) AS d2,
    count(*) FILTER (answerable AND compared AND n_books >= 2) AS n3, count(*) FILTER (answerable AND compared) AS d3, count(*) FILTER (NOT answerable AND n_shown = 0) AS n4, count(*) FILTER (NOT answerable) AS d4,
    count(*) FILTER (answerable AND ch <> '' AND ch_hit) AS n5, count(*) FILTER (answerable AND ch <> '') AS d5, count(DISTINCT ch) FILTER (answerable AND ch <> '' AND ch_hit) AS n6, count(DISTINCT ch) FILTER (answerable AND ch <> '') AS d6 FROM f))""")
def suite_measures(spark, sf_dir):
    """The six measures over all questions, by what the lexical ranking shows."""
    return E.measures(_suite(spark, sf_dir))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id""")
def progress_by_stream(spark, sf_dir):
    """The progress of every job, as a stream with state reports it once all changes have been read."""
    work = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    changes = J.with_event_time(J.stream_of(spark, f"{sf_dir}/events*.parquet", schema))
    J.run_available(J.progress_stream(changes), "update", f"{work}/out", f"{work}/state")
    told = spark.read.parquet(f"{work}/out")
    return told.groupBy("user_id").agg(F.max("n").alias("n"), F.max("failed").alias("failed"), F.max_by("last", "n").alias("last"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY ALL""")
def audit_counts(spark, sf_dir):
    """Review events by day and action."""
    e = J.with_event_time(S.table(spark, sf_dir, "events")).select("ts", F.col("event_type").alias("action"), F.col("user_id").alias("target"))
    return J.audit_log(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "action", "n")


@query("""SELECT source AS topic, rank AS step, lang AS title, substr(text, 1, 320) AS explanation, 'S' || rank AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 48""")
def evidence_steps(spark, sf_dir):
    """The longest documents of each source as steps of a lesson."""
    from pyspark.sql import Window

    d = S.table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).withColumn("path", F.array("lang"))
    return L.evidence_steps(d, "source", "rank", "path", "lang", "text").select(F.col("source").alias("topic"), F.col("step").cast("long").alias("step"), "title", "explanation", "source_id")


@query("""WITH t AS (SELECT 'Widget' AS name UNION ALL SELECT 'olt' UNION ALL SELECT 'zz9')
  SELECT DISTINCT p_partkey FROM part, t WHERE contains(lower(p_name), lower(name))""")
def nodes_locked(spark, sf_dir):
    """Nodes that commands to keep a name lock."""
    told = spark.createDataFrame([("keep", ["Widget", "olt"]), ("keep", ["zz9"]), ("merge", ["a"])], "operation string, targets array<string>")
    return L.locked_by(S.table(spark, sf_dir, "part"), told, "p_partkey", "p_name")
