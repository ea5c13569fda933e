"""Text, retrieval, evidence and evaluation queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment as A
from ..operators import retrieval as V
from ..operators import sections as X
from ..operators import segmentation as G
from ..operators.matching import standing
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


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', ' ', 'g') AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(65533), ' '), '\n[0-9]+\n', chr(10), 'g'), '(?m)^[0-9]+[ \t]*$', '', 'g') AS t FROM a),
  c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
  SELECT doc_id, sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS cleaned, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS n FROM c""")
def clean_text(spark, sf_dir):
    c = T.clean_text("text")
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query("""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token""")
def tokenize_counts(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokenize("text")).alias("token"))
    tf = d.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return tf.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[（(][^)）]*[)）]', '', 'g'), '[^a-z0-9]', '', 'g') AS name_key,
  md5(lower(regexp_replace(p_type || ' ' || p_name, '\s+', '', 'g'))) AS evidence_key FROM part""")
def name_normalize(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return S.table(spark, sf_dir, "part").select("p_partkey", T.normalize_name(name).alias("name_key"), F.md5(T.normalize_evidence(F.concat_ws(" ", "p_type", "p_name"))).alias("evidence_key"))


_GRAMS = "grams AS (SELECT key, list_distinct(list_transform(range(1, length(key)), lambda i: substr(key, i, 2))) AS g FROM (SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key FROM part))"


@query(f"""WITH {_GRAMS}, m AS (SELECT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM part GROUP BY 1)
  SELECT a.key AS a, b.key AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 4) AS score, ma.n * mb.n AS n_pairs
  FROM grams a JOIN grams b ON a.key < b.key JOIN m ma ON ma.key = a.key JOIN m mb ON mb.key = b.key WHERE len(list_intersect(a.g, b.g)) > 0""")
def ngram_jaccard_pairs(spark, sf_dir):
    """Similarity of all names that share a gram, between the classes of equal names, with how many pairs of nodes each stands for.

    An inverted index over the distinct names counts shared grams, so no pair is formed without one and copies cost nothing."""
    named = S.table(spark, sf_dir, "part").groupBy(T.normalize_name("p_type").alias("key")).agg(F.count("*").alias("n"))
    g = named.select("key", "n", T.ngrams("key").alias("g")).select("key", "n", F.size("g").alias("k"), F.explode("g").alias("gram"))
    other = g.select(*(F.col(c).alias(f"{c}_b") for c in ("key", "n", "k")), "gram")
    shared = g.join(other, "gram").where("key < key_b").groupBy("key", "key_b", "n", "n_b", "k", "k_b").agg(F.count("*").alias("both"))
    return shared.select(F.col("key").alias("a"), F.col("key_b").alias("b"), F.round(F.col("both") / (F.col("k") + F.col("k_b") - F.col("both")), 4).alias("score"), (F.col("n") * F.col("n_b")).alias("n_pairs"))


@query("""SELECT d.doc_id AS doc_id, b.item_id AS item_id FROM documents d, benchmark b
  WHERE length(regexp_replace(b.text, '\\s+', '', 'g')) >= 8 AND contains(lower(regexp_replace(d.text, '\\s+', '', 'g')), lower(regexp_replace(b.text, '\\s+', '', 'g')))""".replace("\\\\", "\\"))
def evidence_verify(spark, sf_dir):
    """Verbatim evidence: which quotes stand in which documents, white space and case aside."""
    quotes = S.table(spark, sf_dir, "benchmark").select("item_id", T.normalize_evidence("text").alias("q")).where(F.length("q") >= 8)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", T.normalize_evidence("text").alias("t"))
    return standing(docs, "doc_id", "t", quotes, "q").join(quotes, "q").select("doc_id", "item_id")


_QUALITY = """WITH c AS (SELECT p_partkey, p_name, p_type, CASE p_size % 7 WHEN 1 THEN p_type WHEN 2 THEN '' WHEN 3 THEN 'bad' || chr(65533) || p_type WHEN 4 THEN 'nothing that stands there' ELSE p_brand || ' ' || p_type END AS quote,
    CASE WHEN p_size % 11 = 1 THEN p_type WHEN p_size % 11 = 2 THEN 'short' ELSE p_name || ' ' || p_type END AS def, CASE p_size % 5 WHEN 1 THEN 'formula' WHEN 2 THEN 'mechanism' ELSE 'concept' END AS kind,
    CASE p_size % 13 WHEN 1 THEN '目录' WHEN 2 THEN '第3页' WHEN 3 THEN 'x' WHEN 4 THEN p_name || '，' || p_name || '，' || p_type WHEN 5 THEN p_type ELSE p_name END AS name, p_name || p_brand || p_type AS source FROM part),
  b AS (SELECT *, lower(regexp_replace(quote, '\\s+', '', 'g')) AS q, lower(regexp_replace(source, '\\s+', '', 'g')) AS s FROM c),
  f AS (SELECT *, length(q) >= 8 AND contains(s, q) AS verified FROM b),
  r AS (SELECT p_partkey, verified, [CASE WHEN length(name) NOT BETWEEN 2 AND 80 THEN 'invalid_name_length' END, CASE WHEN name IN ('目录', '第3页') THEN 'noise_term' END, CASE WHEN name = '目录' THEN 'front_matter' END,
      CASE WHEN length(name) > 42 OR name LIKE '%，%，%' THEN 'sentence_as_name' END, CASE WHEN length(def) < 8 THEN 'definition_too_short' END,
      CASE WHEN lower(regexp_replace(def, '\\s+', '', 'g')) = lower(regexp_replace(name, '\\s+', '', 'g')) THEN 'definition_repeats_name' END, CASE WHEN kind = 'mechanism' THEN 'unknown_concept_type' END,
      CASE WHEN quote = '' THEN 'missing_source_quote' END, CASE WHEN contains(quote, chr(65533)) THEN 'broken_source_quote' END, CASE WHEN quote <> '' AND NOT contains(quote, chr(65533)) AND NOT verified THEN 'source_quote_not_found' END] AS l FROM f),
  w AS (SELECT p_partkey, verified, list_filter(l, lambda x: x IS NOT NULL) AS flags FROM r),
  t AS (SELECT *, round(1.0::DOUBLE - coalesce(list_sum(list_transform(flags, lambda x: CASE x WHEN 'invalid_name_length' THEN 0.35 WHEN 'noise_term' THEN 0.5 WHEN 'front_matter' THEN 1.0 WHEN 'sentence_as_name' THEN 0.5 WHEN 'definition_too_short' THEN 0.2
      WHEN 'definition_repeats_name' THEN 0.3 WHEN 'unknown_concept_type' THEN 0.1 WHEN 'broken_source_quote' THEN 1.0 ELSE 0.35 END::DOUBLE)), 0), 4) AS raw FROM w)
  SELECT p_partkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)) AS score, array_to_string(flags, ',') AS flags, verified,
    raw >= 0.45 AND len(list_filter(flags, lambda x: x NOT IN ('definition_too_short', 'definition_repeats_name', 'unknown_concept_type'))) = 0 AS accepted FROM t"""


@query(_QUALITY)
def quality_gate_nodes(spark, sf_dir):
    """The gate of extracted nodes; every flag is raised by some rows."""
    c, size = F.col, F.col("p_size")
    quote = F.when(size % 7 == 1, c("p_type")).when(size % 7 == 2, "").when(size % 7 == 3, F.concat(F.lit("bad\ufffd"), "p_type")).when(size % 7 == 4, "nothing that stands there").otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    definition = F.when(size % 11 == 1, c("p_type")).when(size % 11 == 2, "short").otherwise(F.concat_ws(" ", "p_name", "p_type"))
    kind = F.when(size % 5 == 1, "formula").when(size % 5 == 2, "mechanism").otherwise("concept")
    name = F.when(size % 13 == 1, "目录").when(size % 13 == 2, "第3页").when(size % 13 == 3, "x").when(size % 13 == 4, F.concat("p_name", F.lit("，"), "p_name", F.lit("，"), "p_type")).when(size % 13 == 5, c("p_type")).otherwise(c("p_name"))
    gate = G.node_gate(name, definition, kind, quote, F.concat("p_name", "p_brand", "p_type"))
    return S.table(spark, sf_dir, "part").select("p_partkey", gate["score"].alias("score"), F.array_join(gate["flags"], ",").alias("flags"), gate["verified"].alias("verified"), gate["accepted"].alias("accepted"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey IS NOT NULL AND s_suppkey IS NOT NULL AS known, ['contains', 'causes', 'supports', 'precedes', 'example_of', 'conflicts_with', 'extends'][l_linenumber] AS rel,
    CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN own ELSE 'a quote that is absent' END AS quote FROM (SELECT *, 'order ' || l_orderkey || ' line' AS own FROM lineitem)
    LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 45 LEFT JOIN supplier ON s_suppkey = l_suppkey),
  f AS (SELECT *, rel IN ('causes', 'supports', 'conflicts_with') AS semantic, rel IN ('contains', 'example_of') AS structural, quote LIKE 'order%' AS found FROM c),
  w AS (SELECT *, 1.0::DOUBLE - (l_partkey = l_suppkey)::INT - (NOT known)::INT - (NOT semantic AND NOT structural)::INT - 0.6::DOUBLE * (semantic AND NOT found)::INT AS raw FROM f)
  SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, round(raw, 4)) AS score, raw >= 0.5 AS accepted, structural OR (semantic AND found) AS verified FROM w""")
def edge_quality_gate(spark, sf_dir):
    """The gate of extracted edges, with supported and unsupported relations, and quotes that stand in the source, do not, or are missing."""
    lines, part, sup = (S.table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    known = part.where("p_size <= 45").select("p_partkey")
    j = lines.join(known, F.col("p_partkey") == F.col("l_partkey"), "left").join(sup.select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    relation = F.array(*map(F.lit, ("contains", "causes", "supports", "precedes", "example_of", "conflicts_with", "extends")))[F.col("l_linenumber") - 1]
    own = F.concat_ws(" ", F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("line"))
    quote = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", own).otherwise("a quote that is absent")
    gate = G.edge_gate(F.col("l_partkey"), F.col("l_suppkey"), relation, F.col("p_partkey").isNotNull() & F.col("s_suppkey").isNotNull(), quote, F.concat_ws(" ", F.lit("in"), own))
    return j.select("l_orderkey", "l_linenumber", gate["score"].alias("score"), gate["accepted"].alias("accepted"), gate["verified"].alias("verified"))


_BM25 = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
  len AS (SELECT d.doc_id, len(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS dl FROM documents d), st AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM len),
  tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
  raw AS (SELECT token, ln((N - df + 0.5) / (df + 0.5)) AS w FROM df, st), idf AS (SELECT token, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw),
  scored AS (SELECT q.item_id, tf.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN tf USING (token) JOIN idf USING (token) JOIN len USING (doc_id), st GROUP BY ALL),
  bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _lexical(spark, sf_dir, k: int) -> DataFrame:
    d, b = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark")
    scored = V.bm25(d.select("doc_id", F.col("text").alias("content")), b.select("item_id", F.col("text").alias("question")), "doc_id", "content", "item_id", "question")
    return V.top_k(scored, "item_id", "doc_id", k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 8")
def bm25_top8(spark, sf_dir):
    """The flagship: the eight best documents for every question."""
    return _lexical(spark, sf_dir, 8).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_VEC = """v AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM v)"""


@query(f"WITH {_VEC} SELECT q AS query_id, d AS vec_id, score, rank FROM vr WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.vector_top_k(q, e.select("vec_id", "embedding"), "query_id", "vec_id", "embedding", 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, g AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20)),
  u AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS part FROM bm WHERE rank <= 60 UNION ALL SELECT item_id, doc_id, 0.05 / (60 + rank) FROM g WHERE rank <= 60)
  SELECT item_id, doc_id, round(sum(part), 8) AS fused FROM u GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    d, b = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark")
    w = Window.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id")
    g = b.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")).join(d.select("doc_id", "source", "n_chars"), "source")
    g = g.withColumn("rank", F.row_number().over(w)).where("rank <= 60")
    return V.fuse({"bm25": _lexical(spark, sf_dir, 60), "graph": g}, "item_id", "doc_id")


@query("""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(regexp_replace(text, '[.,\\n]', ' ', 'g'), ' '), lambda x: length(x) >= 6))) AS topic FROM benchmark),
  h AS (SELECT item_id, topic, bool_or(contains(lower(d.text), lower(topic))) AS hit FROM t, documents d GROUP BY ALL) SELECT item_id, bool_and(hit) AS supported FROM h GROUP BY item_id""")
def scope_support(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("text", r"[.,\n]", " "), " "), lambda x: F.length(x) >= 6))
    topics = S.table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("topic"))
    return V.scope_support(S.table(spark, sf_dir, "documents"), "text", topics, "item_id", "topic")


@query(f"""WITH {_BM25}, r AS (SELECT b.item_id, bm.doc_id, rank, contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) AS hit
    FROM benchmark b LEFT JOIN bm ON bm.item_id = b.item_id AND rank <= 8 LEFT JOIN documents d USING (doc_id)),
  gold AS (SELECT b.item_id, bool_or(contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g'))) AS answerable FROM benchmark b, documents d GROUP BY 1),
  per AS (SELECT item_id, answerable, coalesce(bool_or(hit), false) AS found, count(*) FILTER (hit AND rank <= 3) AS good3, count(*) FILTER (rank <= 3) AS n3 FROM gold LEFT JOIN r USING (item_id) GROUP BY ALL)
  SELECT answerable, count(*) AS n, count(*) FILTER (found) AS n_found, round(count(*) FILTER (found) / count(*), 4) AS recall_at_8,
    CAST(sum(good3) AS BIGINT) AS good_at_3, CAST(sum(n3) AS BIGINT) AS shown_at_3, round(sum(good3) / nullif(sum(n3), 0), 4) AS precision_at_3 FROM per GROUP BY answerable""")
def eval_metrics(spark, sf_dir):
    """Retrieval quality over the questions: recall at 8 and precision at 3, by whether the corpus has the answer."""
    d, b = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark")
    gold = evidence_exact(d, b)
    ranked = _lexical(spark, sf_dir, 8).select("item_id", "doc_id", "rank")
    hits = ranked.join(gold.withColumn("hit", F.lit(True)), ["item_id", "doc_id"], "left")
    per = hits.groupBy("item_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"), F.count_if(F.col("hit") & (F.col("rank") <= 3)).alias("good3"), F.count_if(F.col("rank") <= 3).alias("n3"))
    answerable = gold.select("item_id").distinct().withColumn("answerable", F.lit(True))
    all_items = b.select("item_id").join(answerable, "item_id", "left").join(per, "item_id", "left")
    all_items = all_items.select(F.coalesce("answerable", F.lit(False)).alias("answerable"), F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("good3", F.lit(0)).alias("good3"), F.coalesce("n3", F.lit(0)).alias("n3"))
    return all_items.groupBy("answerable").agg(
        F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.round(F.count_if("found") / F.count("*"), 4).alias("recall_at_8"),
        F.sum("good3").alias("good_at_3"), F.sum("n3").alias("shown_at_3"), F.round(F.try_divide(F.sum("good3"), F.sum("n3")), 4).alias("precision_at_3"),
    )


def evidence_exact(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id where the quote stands in the document, white space aside."""
    bare = lambda c: F.regexp_replace(T.text(c), r"\s+", "")
    asked = quotes.select("item_id", bare("text").alias("q"))
    return standing(docs.select("doc_id", bare("text").alias("t")), "doc_id", "t", asked, "q").join(asked, "q").select("item_id", "doc_id")


@query("""SELECT lang, source, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS numerator, round(avg(quality), 4) AS share FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""")
def eval_breakdown(spark, sf_dir):
    j = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(S.table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("numerator"), F.round(F.avg("quality"), 4).alias("share"))


@query(r"""SELECT doc_id, line_no, level, title FROM (SELECT doc_id, i AS line_no, lines[i] AS line, CASE WHEN regexp_matches(lines[i], '^## ') THEN 2 ELSE 1 END AS level,
  trim(regexp_replace(lines[i], '^#+', '')) AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, 100000) t(i) WHERE i <= len(lines))
  WHERE regexp_matches(line, '^(?:[cC][hH][aA][pP][tT][eE][rR][ \t]+[0-9]+[ \t]*.*|#{1,2}[ \t]+.+|[A-Z][^.,;!?|]{1,38}\.)$')""")
def heading_markers(spark, sf_dir):
    lines = G.lines(S.table(spark, sf_dir, "documents"), "doc_id", "text")
    # the documents have no chapter lines: a short line of one sentence plays the heading
    marks = G.heading_marks(lines, "doc_id", extra=r"^[A-Z][^.,;!?|]{1,38}\.$")
    return marks.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "level", "title")


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS heading,
  length(html) AS n_html, md5(url) AS url_key FROM pages""")
def page_html_extract(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    return S.html_pages(p).join(p.select("page_id", F.length("html").cast("long").alias("n_html")), "page_id").select("page_id", "heading", "n_html", F.md5("url").alias("url_key"))


@query("""SELECT lang, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS signature, count(*) AS n_chunks FROM documents GROUP BY lang""")
def corpus_signature(spark, sf_dir):
    return V.corpus_signature(S.table(spark, sf_dir, "documents"), ["lang"], "doc_id", "text")


@query("""WITH s AS (SELECT lang, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS now, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id) FILTER (source <> 'src7')) AS built, count(*) FILTER (source = 'src7') AS n FROM documents GROUP BY lang)
  SELECT lang, CASE WHEN lang = 'de' THEN 'not_built' WHEN now = built THEN 'ready' ELSE 'stale' END AS status FROM s""")
def index_staleness(spark, sf_dir):
    """An index is stale when the signature of its scope is no longer the one it was built with."""
    d = S.table(spark, sf_dir, "documents")
    now = V.corpus_signature(d, ["lang"], "doc_id", "text").select("lang", F.col("signature").alias("now"))
    built = V.corpus_signature(d.where("source <> 'src7' AND lang <> 'de'"), ["lang"], "doc_id", "text").select("lang", F.col("signature").alias("built"))
    state = F.when(F.col("built").isNull(), "not_built").when(F.col("now") == F.col("built"), "ready").otherwise("stale")
    return now.join(built, "lang", "left").select("lang", state.alias("status"))


@query("""SELECT doc_id, substr(text, greatest(instr(lower(text), 'the ') - 180, 1), 1400) AS passage, instr(lower(text), 'the ') > 0 AS anchored FROM documents""")
def passage_window(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", V.passage_window(F.col("text"), F.lit("the ")).alias("passage"), (F.instr(F.lower("text"), "the ") > 0).alias("anchored"))


@query("""SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN lower(source) = 'src1' THEN 0 WHEN starts_with(lower(source), 'src1') THEN 2 WHEN contains(lower(substr(text, 1, 80)), 'the') THEN 3 ELSE 4 END, doc_id) AS rank,
  source, text FROM documents WHERE starts_with(lower(source), 'src1') OR contains(lower(text), 'the')) ORDER BY rank LIMIT 30""")
def reading_search_rank(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    kind = F.when(F.lower("source") == "src1", 0).when(F.lower("source").startswith("src1"), 2).when(F.lower(F.substring("text", 1, 80)).contains("the"), 3).otherwise(4)
    hits = d.where(F.lower("source").startswith("src1") | F.lower("text").contains("the")).select("doc_id", kind.alias("kind"))
    top = hits.orderBy("kind", "doc_id").limit(30)
    return top.select("doc_id", F.row_number().over(Window.orderBy("kind", "doc_id")).cast("long").alias("rank"))


@query(r"""SELECT conv_id, turn, n, n_uncited FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?。！？\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s, len(s) AS n,
  len(list_filter(s, lambda x: NOT contains(x, '[S1]'))) AS n_uncited FROM conversations WHERE role = 'assistant')""")
def citation_coverage(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("k"), "text", F.array(F.lit("S1")).alias("known"))
    u = V.uncited(c, "k", "text", "known")
    return u.select("k.conv_id", "k.turn", F.col("n_sentences").cast("long").alias("n"), F.col("n_uncited").cast("long").alias("n_uncited"))


@query("""SELECT source, count(*) AS n_pages, count(*) FILTER (trim(text) = '') AS n_empty, 0::BIGINT AS n_repaired, 0::BIGINT AS n_broken, false AS needs_ocr FROM documents GROUP BY source""")
def page_statistics(spark, sf_dir):
    return S.page_statistics(S.table(spark, sf_dir, "documents"), "text", ("source",))


_BLOCK = """n AS (SELECT p_partkey AS id, p_brand AS book, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, regexp_replace(lower(substr(p_type, 1, 260)), '[^a-z0-9]', '', 'g') AS def FROM part),
  g AS (SELECT id, book, 'name' AS field, 3 AS w, 200 AS most, unnest(list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2)))) AS gram FROM n
    UNION ALL SELECT id, book, 'definition', 1, 120, unnest(list_distinct(list_transform(range(1, length(def) - 1), lambda i: substr(def, i, 3)))) FROM n),
  c AS (SELECT field, gram FROM g GROUP BY field, gram, most HAVING count(*) <= most)"""


@query(f"""WITH {_BLOCK}, p AS (SELECT a.id AS a, b.id AS b, sum(a.w)::BIGINT AS weight FROM g a JOIN c USING (field, gram) JOIN g b USING (field, gram) WHERE a.book <> b.book AND a.id <> b.id GROUP BY ALL)
  SELECT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM p) WHERE k <= 10""")
def blocking_candidates(spark, sf_dir):
    """Ten candidates for each node from an inverted index over name pairs and definition triples; grams of over 200 and 120 nodes are left out by rule."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("book"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"))
    return A.blocks(p, "id", "book").select("a", "b", "weight")


@query()
def alignment_scores(spark, sf_dir):
    """Scored and qualified pairs of concepts across books."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("book"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"), F.col("p_brand").alias("chapter"))
    return A.scored(A.blocks(p, "id", "book"), p, "id")


@query()
def sequence_ratio(spark, sf_dir):
    """Ratcliff-Obershelp ratio of each name and its type."""
    return S.table(spark, sf_dir, "part").select("p_partkey", A.sequence_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query()
def semantic_chunks(spark, sf_dir):
    """Section-aware chunks of every document, with offsets and paths."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return X.chunks(d, "doc_id", "source", "text")


@query()
def greedy_compression(spark, sf_dir):
    """Which parts of each brand a budget of three tenths of its characters keeps."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.length(F.concat("p_name", "p_type")).alias("size"), (F.col("p_size") == 1).alias("locked"))
    return A.greedy_budget(p, "book", "id", "score", "size", "locked", 0.3)
