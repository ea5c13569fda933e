"""Jobs, delivery checks, dialogue, evaluation suites and client models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delivery as D
from ..operators import relational as R
from ..sources import tables as S
from ..streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'waiting_user' ELSE 'completed' END"


def jobs(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "waiting_user").otherwise("completed")
    tries = F.get_json_object("props", "$.k").cast("int") % 5
    return e.select("event_id", "user_id", "ts", status.alias("status"), tries.alias("retry_count"), F.lit("run").alias("stage"))


@query(f"""SELECT event_id, CASE WHEN s IN ('pending', 'processing') THEN 'pending' ELSE s END AS status, r + (s IN ('pending', 'processing'))::INT AS retry_count,
  s = 'failed' AND r < 3 AS may_retry FROM (SELECT event_id, {_STATUS} AS s, (props ->> 'k')::INT % 5 AS r FROM events)""")
def job_recovery(spark, sf_dir):
    before = jobs(spark, sf_dir).withColumn("may_retry", J.may_retry(F.col("status"), F.col("retry_count")))
    return J.recovered(before).select("event_id", "status", "retry_count", "may_retry")


@query(f"""SELECT user_id, event_id, {_STATUS} AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def case_progress(spark, sf_dir):
    return J.latest_states(jobs(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_window(spark, sf_dir):
    w = J.event_windows(S.table(spark, sf_dir, "events"), "1 day")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    s = J.sessions(S.table(spark, sf_dir, "events"), "6 hours")
    return s.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'signup') AND bool_and(value < 99) THEN 'pending' WHEN bool_or(event_type = 'signup') THEN 'waiting_user' ELSE 'completed' END AS status FROM events GROUP BY user_id""")
def job_resume(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    runs = e.groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "signup"), "waiting_user").otherwise("completed").alias("status"))
    return J.resumable(runs, e.select("user_id", "event_id", (F.col("value") < 99).alias("ok")), "user_id", "event_id", "ok")


@query()
def optimistic_writes(spark, sf_dir):
    """Writes that expect a revision, applied in order of arrival."""
    e = S.table(spark, sf_dir, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("int") % 4).alias("expected"))
    return J.applied_writes(e, "user_id", "expected", "event_id")


@query(r"""SELECT conv_id, turn, CASE WHEN contains(t, 'tion and') THEN 'split' WHEN contains(t, 'with') THEN 'merge' WHEN contains(t, 'the ') THEN 'keep' WHEN contains(t, 'que') THEN 'remove' ELSE 'explain' END AS command
  FROM (SELECT *, lower(text) AS t FROM conversations WHERE role = 'user')""")
def teacher_commands(spark, sf_dir):
    words = {"split": ["tion and"], "merge": ["with"], "keep": ["the "], "remove": ["que"]}
    return S.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", D.command(F.col("text"), words).alias("command"))


@query("""SELECT event_id, CASE WHEN v = 402 THEN 'quota' WHEN v IN (401, 403) THEN 'credentials' WHEN event_type = 'click' THEN 'timeout' WHEN event_type = 'signup' THEN 'connection' WHEN v BETWEEN 400 AND 404 THEN 'request'
  WHEN event_type = 'view' THEN 'empty' ELSE 'other' END AS error_class FROM (SELECT *, 400 + (props ->> 'k')::INT % 10 AS v FROM events)""")
def model_errors(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    message = F.when(F.col("event_type") == "click", "request timed out").when(F.col("event_type") == "signup", "connection refused").when(F.col("event_type") == "view", "").otherwise("failure")
    return e.select("event_id", D.error_class(F.get_json_object("props", "$.k").cast("int") % 10 + 400, message).alias("error_class"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS roles, bool_and(length(text) > 0) AS filled, bool_or(role = 'assistant' AND length(text) > 400) AS long FROM conversations GROUP BY conv_id)
  SELECT conv_id, filled AND roles >= 2 AND n_turns BETWEEN 2 AND 100 AS valid, concat_ws(',', CASE WHEN NOT filled THEN 'empty_text' END, CASE WHEN roles < 2 THEN 'one_sided' END, CASE WHEN n_turns < 2 OR n_turns > 100 THEN 'rows' END, CASE WHEN long THEN 'long_answer' END) AS findings FROM n""")
def draft_validation(spark, sf_dir):
    g = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.countDistinct("role").alias("roles"), F.bool_and(F.length("text") > 0).alias("filled"), F.bool_or((F.col("role") == "assistant") & (F.length("text") > 400)).alias("long"))
    findings = D.findings({"empty_text": ~F.col("filled"), "one_sided": F.col("roles") < 2, "rows": ~F.col("n").between(2, 100), "long_answer": F.col("long")})
    return g.select("conv_id", (F.col("filled") & (F.col("roles") >= 2) & F.col("n").between(2, 100)).alias("valid"), F.array_join(findings, ",").alias("findings"))


@query("""SELECT o_orderkey, sum(l_quantity)::BIGINT AS minutes, count(DISTINCT l_suppkey) AS n_books, count(DISTINCT l_suppkey) >= 2 AS shared, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS grounded
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def source_checks(spark, sf_dir):
    """A claim is shared when two books back it, grounded when every citation is in scope."""
    lines, orders = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "orders")
    scope = S.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("in_scope"))
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(scope, F.col("l_partkey") == F.col("in_scope"), "left")
    return D.claim_checks(rows, "o_orderkey", "l_suppkey", "in_scope", "l_quantity")


@query("""SELECT p_partkey, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 6)::INT AS color FROM part""")
def book_colors(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", T.color_index("p_name").alias("color"))


@query("""SELECT p_brand, CASE WHEN min(p_size) > 1 THEN 'needs_review' WHEN max(p_retailprice) < 999 THEN 'pending' WHEN count(*) < 10 THEN 'partial' ELSE 'ready' END AS status FROM part GROUP BY p_brand""")
def workflow_status(spark, sf_dir):
    g = S.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("a"), F.max("p_retailprice").alias("b"), F.count("*").alias("n"))
    return g.select("p_brand", D.decision([(F.col("a") > 1, "needs_review"), (F.col("b") < 999, "pending"), (F.col("n") < 10, "partial")], "ready").alias("status"))


@query("""SELECT source, doc_id, picked FROM (SELECT source, d.doc_id, coalesce(quality = 1, false) AS picked, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, d.doc_id) AS k
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE k = 1""")
def comparison_columns(spark, sf_dir):
    """One passage for each book: a picked one, else a selected one, else the first."""
    labels = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    j = S.table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    rank = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return R.best_by(j, ["source"], [rank, F.col("doc_id")]).select("source", "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("picked"))


@query("""WITH k AS (SELECT l_orderkey, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem)
  SELECT least(x.p_brand, y.p_brand) AS group_a, greatest(x.p_brand, y.p_brand) AS group_b, count(*) AS n FROM k JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_brand <> y.p_brand GROUP BY ALL""")
def canvas_edges(spark, sf_dir):
    from .reads import links

    g = S.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return D.group_edges(links(spark, sf_dir), g, "source_id", "target_id", "p_partkey", "p_brand")


@query("""WITH c AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
  SELECT source, doc_id, k AS priority, CASE WHEN n_chars > 5000 THEN 'overview' WHEN n_chars > 1000 THEN 'detail' ELSE 'short' END AS question_type FROM c WHERE k <= 2""")
def suite_builder(spark, sf_dir):
    """Two questions for each chapter by priority, with a type."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    d = S.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("priority")).where("priority <= 2")
    kind = D.decision([(F.col("n_chars") > 5000, "overview"), (F.col("n_chars") > 1000, "detail")], "short")
    return d.select("source", "doc_id", "priority", kind.alias("question_type"))


@query("""SELECT lang, sum(least(n_chars, t))::BIGINT AS used, max(t)::BIGINT AS level FROM (SELECT lang, n_chars, 1000 AS t FROM documents) GROUP BY lang""")
def capped_texts(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("lang", F.least("n_chars", F.lit(1000)).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("used"), F.lit(1000).cast("long").alias("level"))


@query("""WITH s AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS run, count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS above, sum(n_chars) OVER (PARTITION BY lang) * .5 AS budget FROM documents),
  f AS (SELECT lang, max(CASE WHEN run + above * n_chars <= budget THEN n_chars ELSE 0 END) AS base, any_value(budget) AS budget FROM s GROUP BY lang),
  g AS (SELECT s.lang, any_value(f.budget) AS budget, sum(CASE WHEN n_chars <= base AND run + above * n_chars <= f.budget THEN n_chars ELSE 0 END) AS filled, count(*) FILTER (NOT (n_chars <= base AND run + above * n_chars <= f.budget)) AS open FROM s JOIN f USING (lang) GROUP BY s.lang)
  SELECT lang, CASE WHEN open > 0 THEN floor((budget - filled) / open)::BIGINT END AS level FROM g""")
def water_level(spark, sf_dir):
    """The length to which texts are cut so that each language keeps half of its characters, short texts whole."""
    return D.water_level(S.table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", "n_chars", 0.5)


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT -1 WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def scope_validation(spark, sf_dir):
    """Ids that a scope names and no table has reject it (one row, -1); scopes without members are listed."""
    c, o = S.table(spark, sf_dir, "customer"), S.table(spark, sf_dir, "orders")
    empty = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")
    foreign = o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").select(F.lit(-1).cast("long").alias("c_custkey")).limit(1)
    return empty.unionByName(foreign)


@query("""SELECT p_brand, count(*) AS n, sum((p_size = 1)::INT)::BIGINT AS locked, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS evidence_signature FROM part GROUP BY p_brand""")
def evidence_signature(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return S.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") == 1).alias("locked"), F.md5(ids).alias("evidence_signature"))
