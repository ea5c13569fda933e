"""Operators on hand rows: joins, windows, retrieval, alignment, sources, delivery."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import alignment as A
from corpusgraph.operators import delivery as D
from corpusgraph.operators import relational as R
from corpusgraph.operators import retrieval as V
from corpusgraph.sources import tables as S


def test_descendants_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "p string, c string")
    got = {(r.root, r.node): r.depth for r in R.descendants(e, "p", "c").collect()}
    assert got["a", "d"] == 3 and got["b", "d"] == 2 and got["c", "d"] == 1


def test_overlaps_once_per_pair(spark):
    a = spark.createDataFrame([("k", 0, 100), ("k", 250, 260), ("j", 0, 5)], "k string, s int, e int")
    b = spark.createDataFrame([("k", 90, 400), ("k", 100, 120)], "k string, x int, y int")
    got = sorted((r.s, r.x) for r in R.overlaps(a, b, ["k"], ("s", "e"), ("x", "y"), 30).collect())
    assert got == [(0, 90), (250, 90)]


def test_common_prefix(spark):
    d = spark.createDataFrame([("a", ["x", "y", "z"]), ("a", ["x", "y"]), ("b", ["q"]), ("b", ["r"]), ("c", ["m", "n"])], "k string, path array<string>")
    assert {r.k: r.prefix for r in R.common_prefix(d, ["k"], "path").collect()} == {"a": ["x", "y"], "b": [], "c": ["m", "n"]}


def test_paging_never_repeats_or_drops(spark):
    d = spark.range(47).withColumn("v", F.col("id") % 5)
    seen = [r.id for k in range(0, 60, 10) for r in R.page(d, [F.desc("v"), F.col("id")], k, 10).collect()]
    assert sorted(seen) == list(range(47)) and len(seen) == 47


def test_stated_blocks_give_the_same_rows(spark):
    d, q = spark.range(20).toDF("x"), spark.range(7).toDF("y")
    one = sorted(map(tuple, R.stated(d, q, F.col("x") % 7 == F.col("y")).collect()))
    assert one == sorted(map(tuple, R.stated(d, q, F.col("x") % 7 == F.col("y"), block=2).collect())) and len(one) == 20


def test_fusion_diversity_and_citations(spark):
    bm = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, d string, rank int")
    vec = spark.createDataFrame([(1, "b", 1)], "q int, d string, rank int")
    got = {r.d: r.fused for r in V.fuse({"bm25": bm, "vector": vec}, "q", "d").collect()}
    assert got == {"a": round(1 / 61, 8), "b": round(1 / 62 + 0.8 / 61, 8)}
    rows = spark.createDataFrame([("x", 9.0, 1), ("x", 8.0, 2), ("y", 1.0, 3)], "book string, s double, id int")
    assert [r.id for r in R.diversify(rows, "book", "s", "id", 2).orderBy("place").collect()] == [1, 3]
    c = V.citations(spark.createDataFrame([(1, "q" * 600, 0.1234567)], "rank int, text string, score double"), "rank", "text", "score").first()
    assert (c.source_id, len(c.quote), c.cited_score) == ("S1", 500, 0.12346)


def test_support_and_refusal(spark):
    d = spark.createDataFrame([("the cell membrane",), ("a cell",)], "t string")
    got = [r.v for r in d.select(V.supports(F.col("t"), ["membrane"]).alias("v")).collect()]
    assert got == [True, False]
    topics = spark.createDataFrame([(1, "cell"), (1, "Membrane"), (2, "cell"), (2, "absent")], "q int, topic string")
    assert {r.q: r.supported for r in V.scope_support(d, "t", topics, "q", "topic").collect()} == {1: True, 2: False}


def test_alignment_is_book_scoped_and_specific(spark):
    rows = [(1, "A", "细胞坏死", "细胞的不可逆死亡过程", "损伤"), (2, "B", "细胞坏死", "细胞不可逆的死亡", "损伤"), (3, "A", "细胞坏死灶", "局部坏死", "x"), (4, "B", "疾病", "疾病概念", "y"), (5, "A", "疾病", "另一种概念", "z")]
    d = spark.createDataFrame(rows, "id int, book string, name string, definition string, chapter string")
    pairs = A.blocks(d, "id", "book")
    assert A.blocks(d, "id", "book", {"name": A.Grams(2, 3, 1)}).count() == 0
    got = {(r.a, r.b): r for r in A.scored(pairs, d, "id").collect()}
    assert (1, 3) not in got and got[1, 2].score >= 0.9 and got[1, 2].qualified
    assert got[2, 3].name_score == round(SequenceMatcher(None, "细胞坏死", "细胞坏死灶").ratio(), 4)
    judged = {(r.a, r.b): (r.relation, r.confidence) for r in A.judged(A.scored(pairs, d, "id")).collect()}
    assert judged[1, 2][0] == "equivalent_to" and judged[1, 2][1] <= 0.82 and judged[2, 3][0] == "related_to"


def test_reviews_and_budget(spark):
    rows = [("pending", "a", "b", "approve"), ("approved", "a", "b", "approve"), ("edited", "", "b", "approve"), ("pending", "", "", "reject"), (None, "a", "b", "edit")]
    got = A.reviewed(spark.createDataFrame(rows, "status string, source_evidence string, target_evidence string, action string")).collect()
    assert [(r.new_status, r.error) for r in got] == [("approved", None), ("approved", 409), ("edited", 400), ("rejected", None), (None, 404)]
    b = spark.createDataFrame([("g", 1, 5.0, 60, False), ("g", 2, 4.0, 30, False), ("g", 3, 3.0, 10, False), ("g", 4, 1.0, 100, True), ("g", 5, 2.0, 1, False)], "g string, id int, s double, n int, locked boolean")
    assert {r.id for r in A.greedy_budget(b, "g", "id", "s", "n", "locked", 0.6).where("kept").collect()} == {4, 3, 5}


def test_reconcile_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, 2, "pending"), (4, 3, "pending"), (5, 6, "approved")], "a int, b int, status string").toDF("x", "y", "status")
    new = spark.createDataFrame([(2, 1), (7, 8)], "x int, y int")
    assert {(r.a, r.b): r.action for r in R.reconcile(old, new, "x", "y").collect()} == {(1, 2): "refresh", (3, 4): "retire", (5, 6): "keep", (7, 8): "create"}
    t = spark.createDataFrame([(1, "old", 0), (2, "stay", 0)], "k int, v string, n int")
    c = spark.createDataFrame([(1, "new", 2), (1, "older", 1), (3, "added", 1)], "k int, v string, n int")
    assert {r.k: r.v for r in S.upsert(t, c, ["k"], "n").collect()} == {1: "new", 2: "stay", 3: "added"}


def test_files_pages_and_report(spark, tmp_path):
    (tmp_path / "01 Notes.md").write_text("# T\n")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    got = {r.title: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got["Notes"].text == "# T\n" and got["Notes"].error is None and got["x"].error == "unsupported format: pdf"
    html = "<style>x{}</style><h1>A &amp; <b>B</b></h1><p>c&nbsp;d</p><script>no()</script>"
    page = S.html_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert (page.heading, page.text) == ("A & B", "A & B c d")
    st = S.page_statistics(spark.createDataFrame([("",), ("a�",), ("b",)], "text string")).first()
    assert (st.n_pages, st.n_empty, st.n_repaired, st.n_broken, st.needs_ocr) == (3, 1, 1, 1, True)
    report = S.markdown_report(spark.createDataFrame([(2, "b*", "y"), (1, "a", "x")], "o int, h string, t string"), "R", "h", "t", ["o"]).first().report
    assert report == "# R\n\n## a\n\nx\n\n## b\\*\n\ny"
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "question": "?"}]}')
    assert S.question_suite(spark, str(tmp_path / "q.json")).first().question == "?"


def test_signature_follows_every_change(spark):
    rows = [(1, "s", "a"), (2, "s", "b")]
    sig = lambda x: V.corpus_signature(spark.createDataFrame(x, "id int, s string, t string"), ["s"], "id", "t").first().signature
    assert sig(rows) == sig(rows[::-1]) != sig([(1, "s", "a"), (2, "s", "c")])


@pytest.mark.parametrize("sizes", [[1, 2, 3], [10, 10, 10], [1, 1, 50], [7]])
def test_water_level(spark, sizes):
    d = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, id int, n long")
    level = D.water_level(d, ["g"], "id", "n", 0.5).first().level
    budget = sum(sizes) * 0.5
    assert sum(min(n, level) for n in sizes) <= budget < sum(min(n, level + 1) for n in sizes)


def test_eligible_nodes(spark):
    rows = [
        (1, "b", "细胞坏死", "细胞的不可逆死亡过程", "细胞坏死是细胞的不可逆死亡过程", "第一章 损伤", "core_concept", "verified", 3, 0.9),
        (2, "b", "细胞坏死。", "细胞的不可逆死亡过程", "细胞坏死是细胞的不可逆死亡过程", "第一章 损伤", "core_concept", "verified", 3, 0.9),
        (3, "b", "第一节 细胞坏死", "细胞的另一种定义在这里", "细胞坏死是细胞的不可逆死亡过程", "第一章 损伤", "section_topic", "verified", 5, 0.1),
        (4, "b", "肝炎的治疗", "细胞的不可逆死亡过程", "细胞坏死是细胞的不可逆死亡过程", "x", "core_concept", "verified", 3, 0.9),
        (5, "b", "概述", "细胞的不可逆死亡过程", "细胞坏死是细胞的不可逆死亡过程", "x", "core_concept", "verified", 3, 0.9),
        (6, "b", "凋亡", "短", "细胞坏死是细胞的不可逆死亡过程", "x", "core_concept", "verified", 3, 0.9),
        (7, "b", "凋亡", "细胞的程序性死亡过程", "短", "x", "core_concept", "verified", 3, 0.9),
        (8, "b", "凋亡", "细胞的程序性死亡过程", "细胞坏死是细胞的不可逆死亡过程", "前言", "core_concept", "verified", 3, 0.9),
        (9, "b", "凋亡", "细胞的程序性死亡过程", "细胞坏死是细胞的不可逆死亡过程", "x", "chapter_topic", "verified", 3, 0.9),
        (10, "c", "凋亡", "细胞的程序性死亡过程", "细胞坏死是细胞的不可逆死亡过程", None, "core_concept", "verified", 3, 0.9),
    ]
    d = spark.createDataFrame(rows, "id int, book string, name string, definition string, source_paragraph string, chapter string, granularity string, evidence_status string, importance int, quality_score double")
    assert sorted(r.id for r in A.eligible(d, "book", "id").collect()) == [3, 10]


def test_compression_keeps_prerequisites_and_chapters(spark):
    rows = [("g", 1, "a", 5.0, 60, False, False), ("g", 2, "a", 4.0, 30, False, False), ("g", 3, "b", 3.0, 90, False, False), ("g", 4, "b", 2.0, 90, False, False), ("g", 5, "c", 1.0, 90, False, True), ("g", 6, "a", 0.5, 95, False, False), ("g", 7, "a", 0.4, 90, True, False)]
    d = spark.createDataFrame(rows, "g string, id int, chapter string, s double, n int, locked boolean, merged boolean")
    edges = spark.createDataFrame([(6, 2), (4, 3)], "source int, target int")
    got = {r.id: r.why for r in A.compressed(d, edges, "g", "id", "chapter", "s", "n", "locked", "merged", 0.5).collect()}
    assert got == {7: "locked", 5: "merged", 1: "budget", 2: "budget", 6: "prerequisite", 3: "chapter"}


def test_matching_strings(spark):
    from corpusgraph.operators import matching as M

    d = spark.createDataFrame([(1, "abcab"), (2, "xbc"), (3, None), (4, "")], "id int, t string")
    q = spark.createDataFrame([("ab",), ("bc",), ("abc",), ("zz",), ("",), (None,), ("ab",)], "p string")
    assert sorted(map(tuple, M.standing(d, "id", "t", q, "p").collect())) == [(1, "ab"), (1, "abc"), (1, "bc"), (2, "bc")]
    assert {r.p for r in M.present(d, "t", q, "p").collect()} == {"ab", "bc", "abc"}
    assert M.standing(d, "id", "t", q.limit(0), "p").count() == 0 == M.present(d.limit(0), "t", q, "p").count()


def test_too_common_tokens_weigh_a_quarter_of_the_mean(spark):
    import math

    texts = ["common rare", "common other", "common third thing", "nothing else"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    q = spark.createDataFrame([(1, "common rare")], "q int, s string")
    got = {r.id: r.score for r in V.bm25(d, q, "id", "t", "q", "s").collect()}
    docs = [x.split() for x in texts]
    df = {w: sum(w in x for x in docs) for x in docs for w in x}
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    size = sum(map(len, docs)) / 4
    want = {i: sum(idf[w] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(x) / size)) for w in ("common", "rare") if w in x) for i, x in enumerate(docs)}
    assert got == {i: round(v, 6) for i, v in want.items() if v > 0}
