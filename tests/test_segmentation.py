"""Headings, chapters, chunks and gates on hand rows."""

from pyspark.sql import functions as F

from corpusgraph.operators import segmentation as G

BOOK = "目录\n第一章 细胞\n第二章 炎症\n正文\n第一章 细胞的损伤与修复\n" + "损伤内容。" * 30 + "\n第14章）。肝的病变\n第二章 炎症\n" + "炎症内容。" * 30 + "\n第二章 炎症\n# Appendix\n" + "end. " * 20


def frame(spark, text):
    return spark.createDataFrame([("b", "Book", text)], "key string, title string, text string")


def test_headings_contents_and_chapters(spark):
    d = frame(spark, BOOK)
    marks = G.heading_marks(G.lines(d, "key", "text"), "key")
    assert [r.title for r in marks.orderBy("line_no").collect()] == ["第一章 细胞", "第二章 炎症", "第一章 细胞的损伤与修复", "第二章 炎症", "第二章 炎症", "Appendix"]
    kept = G.without_contents(marks, "key").orderBy("line_no").collect()
    assert [r.title for r in kept] == ["第一章 细胞的损伤与修复", "第二章 炎症", "Appendix"]
    got = G.chapters(spark.createDataFrame(kept, marks.schema), d, "key", "text").orderBy("order_index").collect()
    assert [(r.order_index, r.title) for r in got] == [(0, "第一章 细胞的损伤与修复"), (1, "第二章 炎症"), (2, "Appendix")]
    assert all(BOOK[r.start : r.stop].startswith(("第", "#")) and r.content.count("\n\n\n") == 0 for r in got)


def test_page_groups_and_spans(spark):
    pages = spark.createDataFrame([("b", i, "p%02d " % i + "x" * 60) for i in range(1, 24)], "book string, page int, text string")
    got = G.page_groups(pages, "book", "page", "text").orderBy("page_start").collect()
    assert [(r.page_start, r.page_end) for r in got][:2] == [(1, 3), (4, 6)] and got[-1].page_end == 23
    spans = G.page_spans(pages.where("page < 4"), "book", "page", "text").orderBy("page").collect()
    assert [(r.start, r.stop) for r in spans] == [(0, 64), (66, 130), (132, 196)]


def test_introduction_is_a_chapter_of_its_own(spark):
    long_, short = "前言正文。" * 60, "短。"
    for opening, titles in ((long_, ["绪论/前言", "第一章 细胞"]), (short, ["第一章 细胞"])):
        d = frame(spark, opening + "\n第一章 细胞\n" + "内容。" * 40)
        marks = G.heading_marks(G.lines(d, "key", "text"), "key")
        got = G.chapters(G.without_contents(marks, "key"), d, "key", "text", every_mark=marks).orderBy("order_index").collect()
        assert [r.title for r in got] == titles and [r.order_index for r in got] == list(range(len(titles)))
    d = frame(spark, BOOK)
    marks = G.heading_marks(G.lines(d, "key", "text"), "key")
    assert G.chapters(G.without_contents(marks, "key"), d, "key", "text", every_mark=marks).where("title = '绪论/前言'").count() == 0


def test_gates(spark):
    rows = [
        ("细胞膜", "细胞的外层结构与边界", "concept", "细胞膜是细胞的外层结构", "……细胞膜是细胞的外层结构。"),
        ("目录", "x", "odd", "", "text"),
        ("细胞膜", "细胞的外层结构与边界", "concept", "不在原文里的引文内容", "text"),
        ("名", "definition ok", "concept", "abcdefgh�", "abcdefgh"),
    ]
    d = spark.createDataFrame(rows, "n string, d string, k string, q string, t string")
    got = [r.g for r in d.select(G.node_gate(*(F.col(c) for c in "ndkqt")).alias("g")).collect()]
    assert got[0].accepted and got[0].score == 1.0 and got[0].verified
    assert {"noise_term", "front_matter", "definition_too_short", "unknown_concept_type", "missing_source_quote"} <= set(got[1].flags) and not got[1].accepted
    assert got[2].flags == ["source_quote_not_found"] and not got[2].accepted
    assert "broken_source_quote" in got[3].flags and "invalid_name_length" in got[3].flags and got[3].score == 0.0
    edges = [("a", "b", "contains", True, "", ""), ("a", "a", "contains", True, "", ""), ("a", "b", "causes", True, "a quote of it", "here a quote of it is"), ("a", "b", "causes", True, "", "x"), ("a", "b", "eats", False, "", "")]
    d = spark.createDataFrame(edges, "s string, t string, r string, k boolean, q string, x string")
    got = [r.g for r in d.select(G.edge_gate(*(F.col(c) for c in "strkqx")).alias("g")).collect()]
    assert [g.accepted for g in got] == [True, False, True, False, False]
