"""Relational reads over the driver's tables, each with its SQL.

Binding: a document's language is its course, its source its book, the document
itself a chapter; parts are graph nodes, order lines are edges from a part to a
supplier, and labels are review states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
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


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.concat_ws("|", "lang", "source").alias("book"), "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 2000 AND source <> 'src3'")
def scope_filter(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(200, 2000) & (F.col("source") != "src3")).select("doc_id", "lang", "source", "n_chars")


@query("""SELECT dimension, value, n FROM (
  SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2
  UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'total', 'all', count(*) FROM documents)""")
def grouping_stats(spark, sf_dir):
    return R.group_stats(S.table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""SELECT d.source AS source, count(*) AS n, count(l.doc_id) AS n_labelled,
  count(*) FILTER (l.quality = 1) AS n_approved, count(*) FILTER (l.quality = 0) AS n_rejected,
  CAST(sum(d.n_chars) AS BIGINT) AS chars, count(DISTINCT d.lang) AS n_courses,
  round(count(*) FILTER (l.quality = 1) / nullif(count(l.doc_id), 0), 4) AS approval
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def conditional_report(spark, sf_dir):
    d, labels = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    j = d.join(labels, d["doc_id"] == labels["labelled"], "left")
    return j.groupBy("source").agg(
        F.count("*").alias("n"), F.count("labelled").alias("n_labelled"),
        F.count_if(F.col("quality") == 1).alias("n_approved"), F.count_if(F.col("quality") == 0).alias("n_rejected"),
        F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("n_courses"),
        F.round(F.try_divide(F.count_if(F.col("quality") == 1), F.count("labelled")), 4).alias("approval"),
    )


@query("""SELECT doc_id, content_hash, accepted FROM (SELECT doc_id, sha256(text) AS content_hash,
  row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) = 1 AS accepted FROM documents)""")
def content_dedup(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return S.first_uploads(d, ["lang"], "text", ["doc_id"]).select("doc_id", "content_hash", "accepted")


@query("""SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, l.l_partkey AS l_partkey FROM lineitem l
  WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 40)""")
def graph_page_edges(spark, sf_dir):
    nodes = S.table(spark, sf_dir, "part").where("p_size >= 40")
    return R.edges_of_nodes(S.table(spark, sf_dir, "lineitem"), nodes, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


_LINKS = """links AS (SELECT l_orderkey, l_linenumber, l_partkey AS source_id,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_id, l_returnflag AS relation FROM lineitem)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts: from each line of an order to the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = S.table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(w).alias("target_id"), F.col("l_returnflag").alias("relation"))
    return lines.where("target_id IS NOT NULL")


@query(f"""WITH {_LINKS}, chosen AS (SELECT p_partkey FROM part WHERE p_size >= 25)
  SELECT relation, count(*) AS n FROM links WHERE target_id IS NOT NULL AND source_id IN (FROM chosen) AND target_id IN (FROM chosen) GROUP BY relation""")
def edges_both_endpoints(spark, sf_dir):
    nodes = S.table(spark, sf_dir, "part").where("p_size >= 25")
    return R.edges_inside(links(spark, sf_dir), nodes, "source_id", "target_id", "p_partkey").groupBy("relation").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINKS}, chosen AS (SELECT p_partkey FROM part WHERE p_size = 7)
  SELECT DISTINCT l_orderkey, l_linenumber, source_id, target_id FROM links WHERE target_id IS NOT NULL AND (source_id IN (FROM chosen) OR target_id IN (FROM chosen))""")
def edges_either_endpoint(spark, sf_dir):
    nodes = S.table(spark, sf_dir, "part").where("p_size = 7")
    key = ["l_orderkey", "l_linenumber", "source_id", "target_id"]
    return R.edges_touching(links(spark, sf_dir), nodes, key, "source_id", "target_id", "p_partkey").select(key)


@query(f"""WITH {_LINKS}, e AS (SELECT source_id, target_id FROM links WHERE target_id IS NOT NULL),
  both_ways AS (SELECT source_id AS node, target_id AS other FROM e UNION ALL SELECT target_id, source_id FROM e WHERE source_id <> target_id)
  SELECT node, count(*) AS degree, count(DISTINCT other) AS n_neighbours, max(other) AS last_neighbour FROM both_ways GROUP BY node""")
def node_neighbors(spark, sf_dir):
    both = R.neighbours(links(spark, sf_dir), "source_id", "target_id")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("n_neighbours"), F.max("other").alias("last_neighbour"))


@query(f"""WITH {_LINKS} SELECT k.l_orderkey AS l_orderkey, k.l_linenumber AS l_linenumber, a.p_name AS source_name, b.p_name AS target_name, a.p_brand = b.p_brand AS same_book
  FROM links k LEFT JOIN part a ON a.p_partkey = k.source_id LEFT JOIN part b ON b.p_partkey = k.target_id WHERE k.target_id IS NOT NULL AND k.relation = 'R'""")
def pair_context(spark, sf_dir):
    pairs = links(spark, sf_dir).where("relation = 'R'")
    got = R.with_pair(pairs, S.table(spark, sf_dir, "part"), "p_partkey", "source_id", "target_id", ["p_name", "p_brand"])
    return got.select("l_orderkey", "l_linenumber", F.col("source_id_p_name").alias("source_name"), F.col("target_id_p_name").alias("target_name"), (F.col("source_id_p_brand") == F.col("target_id_p_brand")).alias("same_book"))


@query("""SELECT o.o_orderkey AS o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 10 WHERE l.l_orderkey = o.o_orderkey AND p.p_partkey IS NULL)""")
def subset_division(spark, sf_dir):
    groups = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey")
    return R.contained_in(groups.join(orders, "o_orderkey"), S.table(spark, sf_dir, "part").where("p_size > 10"), "o_orderkey", "l_partkey", "p_partkey")


@query("""SELECT l_orderkey AS l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey
  HAVING count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)) > 0""")
def array_overlap(spark, sf_dir):
    gone = S.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("_gone"))
    lines = S.table(spark, sf_dir, "lineitem")
    hit = lines.join(gone, lines["l_partkey"] == F.col("_gone"), "left_semi").select(F.col("l_orderkey").alias("_hit")).distinct()
    return lines.join(hit, F.col("l_orderkey") == F.col("_hit"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query("""SELECT * FROM (SELECT doc_id, source, n_chars, count(*) OVER () AS total, count(*) OVER () > 60 AS has_more FROM documents)
  ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40""")
def offset_page_total(spark, sf_dir):
    """A page of a listing: the third twenty of the longest documents."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return R.page(rows, [F.desc("n_chars"), F.col("doc_id")], 40, 20)


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_key(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return R.best_by(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def dedup_best(spark, sf_dir):
    return R.best_by(S.table(spark, sf_dir, "part"), ["p_name"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_name", "p_partkey", "p_retailprice")


@query("""SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_type) DESC, p_type) AS k
  FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE k = 1""")
def modal_value(spark, sf_dir):
    return R.modal_value(S.table(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query("""WITH old AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b,
    max(CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'approved' END) AS status FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
  new AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity > 30)
  SELECT a, b, CASE WHEN status IS NULL THEN 'create' WHEN status <> 'pending' THEN 'keep' WHEN found THEN 'refresh' ELSE 'retire' END AS action
  FROM old FULL JOIN (SELECT *, true AS found FROM new) n USING (a, b)""")
def reconcile_pairs(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem")
    old = lines.where("l_returnflag <> 'R'").withColumn("status", F.when(F.col("l_linestatus") == "O", "pending").otherwise("approved"))
    return R.reconcile(old, lines.where("l_quantity > 30"), "l_partkey", "l_suppkey")


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
  below AS (SELECT parent AS root, child AS node, 1 AS depth FROM e UNION ALL SELECT b.root, e.child, b.depth + 1 FROM below b JOIN e ON e.parent = b.node WHERE b.depth < 16)
  SELECT root, count(*) AS n_below, max(depth) AS deepest, count(*) FILTER (node[1] = 'o') AS n_leaves FROM below GROUP BY root""")
def hierarchy_descendants(spark, sf_dir):
    t = lambda n: S.table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(name("r", "r_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    e = e.unionByName(t("customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    e = e.unionByName(t("orders").select(name("c", "o_custkey").alias("parent"), name("o", "o_orderkey").alias("child")))
    below = R.descendants(e, "parent", "child")
    return below.groupBy("root").agg(F.count("*").alias("n_below"), F.max("depth").alias("deepest"), F.count_if(F.col("node").startswith("o")).alias("n_leaves"))


@query("""SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)""")
def neighborhood_band(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = S.table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w))
    return R.band(e, ["user_id"], "k", F.col("event_type") == "error").select("event_id", "user_id", "event_type", "near")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e FROM orders)
  SELECT x.id AS left_id, y.id AS right_id FROM a x JOIN a y ON x.k = y.k AND x.id < y.id AND x.s < y.e AND y.s < x.e""")
def interval_overlap(spark, sf_dir):
    """Orders of one customer whose thirty days overlap."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    a = S.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("left_id"), day.alias("s"), (day + 30).alias("e"))
    b = a.select("o_custkey", F.col("left_id").alias("right_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return R.overlaps(a, b, ["o_custkey"], ("s", "e"), ("s2", "e2"), 30).where("left_id < right_id").select("left_id", "right_id")


@query("""WITH p AS (SELECT p_type AS k, string_split(p_brand || ' ' || p_name, ' ') AS path FROM part),
  flat AS (SELECT k, path[i] AS label, i FROM p, range(1, 20) t(i) WHERE i <= len(path)), least_len AS (SELECT k, min(len(path)) AS m FROM p GROUP BY k),
  lv AS (SELECT k, i, min(label) AS lo, max(label) AS hi FROM flat GROUP BY k, i),
  bad AS (SELECT l.k, min(CASE WHEN lo <> hi OR i > m THEN i END) AS b FROM lv l JOIN least_len USING (k) GROUP BY l.k)
  SELECT l.k AS p_type, coalesce(string_agg(lo, '/' ORDER BY i) FILTER (i <= m AND (b IS NULL OR i < b)), '') AS prefix FROM lv l JOIN least_len USING (k) JOIN bad USING (k) GROUP BY l.k""")
def common_prefix(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_type", F.split(F.concat_ws(" ", "p_brand", "p_name"), " ").alias("path"))
    return R.common_prefix(p, ["p_type"], "path").select("p_type", F.array_join("prefix", "/").alias("prefix"))


@query("""SELECT turn, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders)
  ORDER BY turn, o_orderpriority LIMIT 48""")
def round_robin_budget(spark, sf_dir):
    """A fair budget: 48 rows, dealt in turn over the groups."""
    got = R.round_robin(S.table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 48)
    return got.select(F.col("turn").cast("long").alias("turn"), "o_orderpriority", "o_orderkey")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1 AS f FROM documents WHERE source IN ('src1', 'src2', 'src5'))
  SELECT source, doc_id, row_number() OVER (ORDER BY f DESC, n_chars DESC, doc_id) AS place FROM r ORDER BY f DESC, n_chars DESC, doc_id LIMIT 8""")
def compare_diversify(spark, sf_dir):
    """Eight results with the best of every requested book first."""
    d = S.table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src5")).select("doc_id", "source", "n_chars")
    return R.diversify(d, "source", "n_chars", "doc_id", 8).select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("""SELECT 'customer' AS t, count(*) AS n_kept FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)""")
def cascade_delete(spark, sf_dir):
    t = lambda n: S.table(spark, sf_dir, n)
    kept = S.cascade_delete(t("nation"), t("nation").where("n_regionkey = 1"), "n_nationkey", {
        "customer": (t("customer"), "c_custkey", "root", "c_nationkey"),
        "orders": (t("orders"), "o_orderkey", "customer", "o_custkey"),
        "lineitem": (t("lineitem"), "l_linenumber", "orders", "l_orderkey"),
    })
    counts = [kept[n].agg(F.lit(n).alias("t"), F.count("*").alias("n_kept")) for n in ("customer", "orders", "lineitem")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT r_name, coalesce(sum(n), 0)::BIGINT AS n_suppliers, CASE WHEN coalesce(sum(n), 0) = 0 THEN 'empty' WHEN count(n) < count(*) THEN 'partial' ELSE 'ready' END AS state
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY r_name""")
def book_totals(spark, sf_dir):
    t = lambda n: S.table(spark, sf_dir, n)
    n = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    j = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return j.groupBy("r_name").agg(total.alias("n_suppliers"), F.when(total == 0, "empty").when(F.count("n") < F.count("*"), "partial").otherwise("ready").alias("state"))


@query("""WITH c AS (SELECT p_brand, count(*) AS n, sum(CASE WHEN p_retailprice > 990 THEN 1 ELSE 0 END) AS fine FROM part GROUP BY 1)
  SELECT kind, n FROM (SELECT 'tables' AS kind, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'books', (SELECT count(*) FROM c)
  UNION ALL SELECT 'problems', (SELECT count(*) FROM c WHERE fine = 0) UNION ALL SELECT 'orphans', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)))""")
def diagnostics(spark, sf_dir):
    part, lines = S.table(spark, sf_dir, "part"), S.table(spark, sf_dir, "lineitem")
    c = part.groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") > 990).alias("fine"))
    orphans = lines.join(part, lines["l_partkey"] == part["p_partkey"], "left_anti")
    rows = [part.agg(F.lit("tables").alias("kind"), F.count("*").alias("n")), c.agg(F.lit("books").alias("kind"), F.count("*").alias("n")), c.agg(F.lit("problems").alias("kind"), F.count_if(F.col("fine") == 0).alias("n")), orphans.agg(F.lit("orphans").alias("kind"), F.count("*").alias("n"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""SELECT p_partkey, round(.35 * least(n / 7.0, 1) + .25 * (p_size % 5 + 1) / 5.0 + .10 + .10 * (p_type LIKE '%BRASS%')::INT + .10 * (p_size > 45)::INT, 4) AS retention
  FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM part)""")
def retention_score(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("p_name"))
    value = 0.35 * F.least(n / 7.0, F.lit(1.0)) + 0.25 * (F.col("p_size") % 5 + 1) / 5.0 + 0.10 + 0.10 * F.col("p_type").contains("BRASS").cast("int") + 0.10 * (F.col("p_size") > 45).cast("int")
    return S.table(spark, sf_dir, "part").select("p_partkey", F.round(value, 4).alias("retention"))


@query("""SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS original, CAST(sum(CASE WHEN k = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS kept,
  round(sum(CASE WHEN k = 1 THEN n_chars ELSE 0 END) / greatest(sum(n_chars), 1), 4) AS ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM documents) GROUP BY source""")
def compression_summary(spark, sf_dir):
    w = Window.partitionBy("source", "h").orderBy("doc_id")
    d = S.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.sha2("text", 256).alias("h")).withColumn("k", F.row_number().over(w))
    kept = F.sum(F.when(F.col("k") == 1, F.col("n_chars")).otherwise(0))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("original"), kept.alias("kept"), F.round(kept / F.greatest(F.sum("n_chars"), F.lit(1)), 4).alias("ratio"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, len(list_distinct(list(event_type))) = 5 AS covered FROM events GROUP BY user_id""")
def scope_coverage(spark, sf_dir):
    kinds = F.sort_array(F.collect_set("event_type"))
    return S.table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"), (F.size(kinds) == 5).alias("covered"))


@query("""SELECT doc_id, source, rn <= ceil(n * 0.3) AS kept FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def quota_per_book(spark, sf_dir):
    w = Window.partitionBy("source")
    d = S.table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("rn"), F.count("*").over(w).alias("n"))
    return d.select("doc_id", "source", (F.col("rn") <= F.ceil(F.col("n") * F.lit(0.3))).alias("kept"))


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_operations(spark, sf_dir):
    lines, orders = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "orders")
    a = lines.where("l_returnflag = 'A'").select("l_orderkey")
    return a.intersect(lines.where("l_linestatus = 'O'").select("l_orderkey")).subtract(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))


@query("""SELECT o_orderkey, o_custkey, o_orderdate < lag(o_orderdate) OVER w AS out_of_order, coalesce(date_diff('day', lag(o_orderdate) OVER w, o_orderdate), 0) AS gap_days
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def order_validity(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_orderdate").over(w)
    gap = F.coalesce(F.datediff(F.col("o_orderdate"), before), F.lit(0)).cast("long")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") < before).alias("out_of_order"), gap.alias("gap_days"))


@query("""SELECT user_id, min(event_id) AS first_event, count(*) AS n, event_type FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
  SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, island, event_type""")
def gaps_and_islands(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = S.table(spark, sf_dir, "events").withColumn("b", F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1))
    e = e.withColumn("island", F.sum("b").over(w))
    return e.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("island")
