"""Graph, board and evidence queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..sources import tables as S
from .reads import _LINKS, links

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_E = f"{_LINKS}, e AS (SELECT * FROM links WHERE target_id IS NOT NULL), both_ways AS (SELECT source_id AS node, target_id AS other FROM e UNION ALL SELECT target_id, source_id FROM e WHERE source_id <> target_id)"


def both_ways(spark, sf_dir):
    return R.neighbours(links(spark, sf_dir), "source_id", "target_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'eau') OR contains(lower(text), '100%') OR contains(lower(text), 'schön_')")
def ilike_filter(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").where(G.ilike_any(F.col("text"), ["EAU", "100%", "schön_"])).select("doc_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' OR (l_linestatus = 'F' AND l_discount < 0.05) GROUP BY ALL")
def trusted_edges(spark, sf_dir):
    review = F.when(F.col("l_returnflag") == "A", "approved").otherwise("pending")
    rows = S.table(spark, sf_dir, "lineitem").where(G.trusted(review, F.col("l_linestatus") == "F", F.col("l_discount") < 0.05))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_brand, p_type, min(p_partkey) AS f, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS items FROM part GROUP BY ALL)
  SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY f) AS place, n, items FROM g""")
def concept_groups(spark, sf_dir):
    g = G.concept_groups(S.table(spark, sf_dir, "part"), "p_brand", "p_type", ["p_partkey"], "p_partkey")
    return g.select("p_brand", "p_type", F.col("place").cast("long").alias("place"), "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"""WITH {_E}, d AS (SELECT DISTINCT node, other FROM both_ways), r AS (SELECT node, p_name, row_number() OVER (PARTITION BY node ORDER BY p_name, other) AS k FROM d JOIN part ON p_partkey = other)
  SELECT node, count(*) AS n, string_agg(p_name, '; ' ORDER BY k) AS context FROM r WHERE k <= 30 GROUP BY node""")
def node_context(spark, sf_dir):
    return G.node_context(S.table(spark, sf_dir, "part"), both_ways(spark, sf_dir), "p_partkey", "p_name")


@query(f"""WITH {_E}, s AS (SELECT p_partkey AS node FROM part WHERE p_size = 2 AND p_partkey % 20 = 0), g AS (SELECT p_partkey AS node FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey IN (FROM s))),
  b AS (SELECT node, 0 AS d FROM s UNION ALL SELECT node, 1 FROM g), base AS (SELECT node, min(d) AS d FROM b GROUP BY node),
  a AS (FROM base UNION ALL SELECT other, 2 FROM both_ways WHERE node IN (SELECT node FROM base)) SELECT node, ['seed', 'group', 'edge'][min(d) + 1] AS via FROM a GROUP BY node""")
def graph_expansion(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return G.expand(p.where("p_size = 2 AND p_partkey % 20 = 0"), p, links(spark, sf_dir), "p_partkey", "p_name", "source_id", "target_id")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE k <= 4 AND b < 1000""")
def section_gather(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return G.gather(c, ["conv_id"], "turn", "n", most_rows=4, most_size=1000).select("conv_id", "turn")


@query("""SELECT p_partkey, CASE WHEN count(DISTINCT p_brand) FILTER (k <> '') OVER (PARTITION BY k) > 1 THEN 'merge' WHEN p_retailprice >= 950 THEN 'keep' ELSE 'drop' END AS decision
  FROM (SELECT *, regexp_replace(lower(p_name || p_type || p_size), '[^a-z0-9]', '', 'g') AS k FROM part)""")
def merge_decisions(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", "p_type", F.col("p_size").cast("string")))
    return G.merge_decisions(p, "p_partkey", "p_brand", "name", "p_retailprice", 950)


@query("""WITH o AS (SELECT p_name, p_type, min(p_partkey) AS f, count(*) AS n, sum(length(p_type)) AS c FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY f) AS k FROM o)
  SELECT p_name, sum(n)::BIGINT AS n_sources, sum(c)::BIGINT AS chars_before, length(string_agg(p_type, chr(10) ORDER BY k) FILTER (k <= 2)) AS chars_after, string_agg(p_type, chr(10) ORDER BY k) FILTER (k <= 2) AS text FROM r GROUP BY p_name""")
def integration_text(spark, sf_dir):
    return G.integrated(S.table(spark, sf_dir, "part"), ["p_name"], [F.col("p_partkey")], "p_type")


@query(f"""WITH {_E}, near AS (SELECT DISTINCT other AS n FROM both_ways WHERE node IN (SELECT p_partkey FROM part WHERE p_partkey < 3)),
  r AS (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey < 3 THEN 0 WHEN p_partkey IN (FROM near) THEN 1 WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 THEN 2 ELSE 3 END AS r FROM part),
  k AS (SELECT *, row_number() OVER (ORDER BY r >= 3, p_retailprice DESC, p_partkey) AS k, count(*) FILTER (r < 3) OVER () AS shown FROM r)
  SELECT p_partkey, ['anchor', 'neighbour', 'book', 'score'][r + 1] AS reason FROM k WHERE r < 3 OR k <= greatest(150, shown)""")
def visible_concepts(spark, sf_dir):
    return G.visible(S.table(spark, sf_dir, "part"), both_ways(spark, sf_dir), F.col("p_partkey") < 3, "p_partkey", "p_brand", "p_retailprice", 150)


@query(f"""WITH {_E}, k AS (SELECT l_orderkey * 10 + l_linenumber AS id, source_id, target_id FROM e), c AS (SELECT p_partkey FROM part WHERE p_size > 2)
  SELECT DISTINCT id, 'missing_card' AS violation FROM k WHERE source_id NOT IN (FROM c) OR target_id NOT IN (FROM c) UNION ALL SELECT id, 'self_link' FROM k WHERE source_id = target_id
  UNION ALL SELECT id, 'repeated' FROM (SELECT id, row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY id) AS n FROM k) WHERE n > 1""")
def board_violations(spark, sf_dir):
    k = links(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "source_id", "target_id")
    return G.board_violations(k, S.table(spark, sf_dir, "part").where("p_size > 2"), "id", "source_id", "target_id", "p_partkey")


_TREE = "t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 5 > 0 THEN o_orderkey - o_orderkey % 5 END AS parent, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS level, o_orderkey // 2 + o_orderkey % 2 * 100000000 + (o_orderkey % 11 = 0)::INT AS pos, o_orderkey - o_orderkey % 5 AS s, o_orderkey - o_orderkey % 5 + o_orderkey % 3 AS e FROM orders)"


@query(f"""WITH {_TREE}, j AS (SELECT t.*, p.id AS pid, p.level AS pl, p.s AS ps, p.e AS pe, count(*) OVER (PARTITION BY t.pos) AS same FROM t LEFT JOIN t p ON p.id = t.parent)
  SELECT id, 'missing_parent' AS finding FROM j WHERE parent IS NOT NULL AND pid IS NULL UNION ALL SELECT id, 'level' FROM j WHERE pid IS NOT NULL AND level <> pl + 1
  UNION ALL SELECT id, 'order' FROM j WHERE same > 1 UNION ALL SELECT id, 'range' FROM j WHERE s > e OR (pid IS NOT NULL AND (s < ps OR e > pe))""")
def chapter_tree_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    t = S.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 7 == 0, k + 1).when(k % 5 > 0, k - k % 5).alias("parent"), F.when(k % 5 == 0, 1).otherwise(2).alias("level"),
        (F.expr("o_orderkey div 2") + k % 2 * 100000000 + (k % 11 == 0).cast("int")).alias("pos"), (k - k % 5).alias("s"), (k - k % 5 + k % 3).alias("e"))
    return G.tree_findings(t, "id", "parent", "level", "pos", "s", "e")


@query("""WITH r AS (SELECT o_custkey AS g, o_orderkey AS id, 1 + o_orderkey % 4 AS level FROM orders)
  SELECT a.id, (SELECT max(b.id) FROM r b WHERE b.g = a.g AND b.id < a.id AND b.level < a.level) AS parent FROM r a""")
def parents_from_levels(spark, sf_dir):
    r = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 4).alias("level"))
    return G.parent_of(r, ["g"], "id", "level", "id").select("id", "parent")


@query("""WITH ok AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 4 AND bool_and(l_suppkey <> 1)), old AS (SELECT p_partkey FROM part WHERE p_size > 40)
  SELECT p_partkey, 'current' AS accepted_from FROM old UNION ALL SELECT l_partkey, min(l_orderkey::VARCHAR) FROM lineitem WHERE l_orderkey IN (FROM ok) AND l_partkey NOT IN (FROM old) GROUP BY 1""")
def merged_batches(spark, sf_dir):
    deltas = S.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return G.merged_batches(S.table(spark, sf_dir, "part").where("p_size > 40"), deltas, "l_orderkey", "p_partkey", F.col("l_suppkey") == 1, 4)


@query(f"""WITH {_E} SELECT (SELECT count(*) FROM part WHERE p_size <> 9) AS cards, count(*) AS links FROM e WHERE source_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 9) AND target_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 9)""")
def selection_cascade(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    cards, left = G.removed_selection(p, links(spark, sf_dir), p.where("p_size = 9"), "p_partkey", "source_id", "target_id")
    return cards.agg(F.count("*").alias("cards")).crossJoin(left.agg(F.count("*").alias("links")))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_sort(list_distinct(list(l_returnflag))) = ['A', 'R']) ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def latest_exact_scope(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return G.exact_scope_runs(S.table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_returnflag", ["R", "A"], "o_totalprice").select("o_orderkey", "o_totalprice")


@query("""SELECT doc_id, source, 'S' || k AS source_id, substr(text, 1, 500) AS quote, round(n_chars / 7.0, 5) AS cited_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 2""")
def fallback_citations(spark, sf_dir):
    """Without a model: the two best passages of every book, cited."""
    from ..operators import retrieval as V

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = S.table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(w)).where("k <= 2").withColumn("score", F.col("n_chars") / 7.0)
    return V.citations(top, "k", "text", "score").select("doc_id", "source", "source_id", "quote", "cited_score")


@query("""SELECT count(*) AS n_decisions, count(*) FILTER (l_returnflag = 'A') AS n_merge, count(*) FILTER (l_returnflag = 'N') AS n_keep, count(*) FILTER (l_returnflag = 'R') AS n_remove,
  round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 4) AS ratio FROM lineitem""")
def course_report(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem")
    count = lambda f: F.count_if(F.col("l_returnflag") == f)
    kept = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0))
    return lines.agg(F.count("*").alias("n_decisions"), count("A").alias("n_merge"), count("N").alias("n_keep"), count("R").alias("n_remove"), F.round(F.try_divide(kept, F.sum("l_quantity")), 4).alias("ratio"))
