"""Suites, scorecards and lessons on hand rows."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import evaluation as E
from corpusgraph.operators import graph as G
from corpusgraph.operators import lessons as L
from corpusgraph.operators import relational as R

Q = f"id string, answerable boolean, mode string, concepts {E.CONCEPTS}, terms array<string>, chapter_id string, chapter_title string, min_books int"
ITEMS = "id string, rank int, item string, book string, chapter_id string, chapter string, content string, path array<string>, page_start int, page_end int"


def test_measures(spark):
    phases = [(x, [x + "期"]) for x in ("充血", "红色", "灰色", "消散")]
    questions = spark.createDataFrame([
        ("one", True, "all", None, ["炎症"], "c1", "第一章", None), ("four", True, "compare", phases, ["不用"], None, None, 2), ("pair", True, "all", [("坏死", []), ("凋亡", ["程序性死亡"])], None, "", None, None),
        ("none", False, "all", None, None, None, None, None), ("shown", False, "all", None, None, None, None, None), ("lost", True, "all", None, ["炎症"], "c2", None, None),
    ], Q)
    results = spark.createDataFrame([
        ("one", 1, "a", "x", "c1", "第一章", "炎 症是", [], 3, 4), ("one", 2, "b", "x", "c9", "别章", "炎症", [], 3, 4), ("one", 3, "c", "x", "c1", "第一章", "炎症", [], 0, 0), ("one", 9, "d", "x", "c1", "第一章", "炎症", [], 1, 1),
        ("four", 1, "a", "x", "c", "c", "充血期", ["红色期"], 1, 1), ("four", 2, "b", "y", "c", "c", "灰色", [], 1, 1), ("four", 4, "c", "y", "c", "c", "与此无关", [], 1, 1),
        ("pair", 1, "a", "x", "c", "c", "坏死", [], 2, 1), ("shown", 1, "a", "x", "c", "c", "t", [], 1, 1),
    ], ITEMS)
    got = {r.id: r for r in E.judged(questions, results, "id").collect()}
    assert got["one"].retrieval_hit and got["one"].chapter_hit and (got["one"].citation_hits, got["one"].citation_count) == (1, 3)
    assert got["four"].retrieval_hit and got["four"].chapter_hit is None and got["four"].compare_hit and got["four"].citation_count == 2
    assert not got["pair"].retrieval_hit and got["none"].rejected and not got["shown"].rejected and got["lost"].chapter_hit is False
    m = {r.metric: (r.numerator, r.denominator, r.ratio) for r in E.measures(E.judged(questions, results, "id")).collect()}
    assert m == {"retrieval_recall": (2, 4, 0.5), "citation_precision": (3, 6, 0.5), "cross_book_coverage": (1, 1, 1.0), "refusal": (1, 2, 0.5), "chapter_question_hit": (1, 2, 0.5), "chapter_coverage": (1, 2, 0.5)}
    assert {r.ratio for r in E.measures(E.judged(questions.limit(0), results, "id")).collect()} == {0.0}


def test_wanted(spark):
    assert [r.w for r in spark.range(7).orderBy("id").select(E.wanted(F.col("id")).alias("w")).collect()] == [0, 1, 2, 2, 3, 3, 4]


def test_scorecard(spark):
    frame = spark.createDataFrame
    got = E.scorecard(
        frame([("confirmed",), ("open",)], "review_status string"), frame([(1, 2), (0, 0), (3, 2)], "page_start int, page_end int"),
        frame([("core_concept", "verified", "s"), ("core_concept", "verified", ""), ("section_topic", "verified", "s")], "granularity string, evidence_status string, source_paragraph string"),
        frame([(1, "causes"), (2, "contains"), (3, "causes")], "id int, relation string"), frame([(1, True), (1, True), (3, False)], "edge_id int, quote_verified boolean"),
        frame([("approved",), ("pending",), ("rejected",)], "status string"), frame([], "hit boolean"), ("contains",),
    )
    assert {r.metric: (r.numerator, r.denominator) for r in got.collect()} == {"chapters_confirmed": (1, 2), "pages_traceable": (1, 3), "core_evidence": (1, 2), "relation_evidence": (1, 2), "candidates_reviewed": (2, 3), "source_hit_at_5": (0, 0)}


@pytest.mark.parametrize(("heading", "kind"), [("第一节 炎症", "exact"), ("炎症（inflammation）", "exact"), ("二、炎症的功能", "scoped"), ("炎症、坏死", ""), ("急性炎症", ""), ("", "")])
def test_headings_that_name_a_topic(heading, kind):
    assert L.names_topic(heading, "炎症") == kind


def test_introductions(spark):
    assert L.introduces("炎症", ["第一章", "第一节 炎症"], "炎症\n是反应", "炎症") == pytest.approx(1.2 + 1.8)
    assert L.introduces("炎症", ["第一章", "炎症习题"], "题", "炎症") == pytest.approx(0.8 - 1.4)
    rows = [("q", "b", "k1", "A text", 1, 2, 0.0, 0), ("q", "b", "k2", "a  TEXT", 2, 2, 0.0, 1), ("q", "b", "k3", "other", None, 5, 3.0, 2)]
    d = spark.createDataFrame(rows, "query string, book string, key string, content string, lexical_rank int, literal int, bonus double, chunk_index int")
    assert [(r.key, r.place) for r in L.bridge(d, "query", "key").orderBy("place").collect()] == [("k3", 1), ("k1", 2)]
    b = spark.createDataFrame([("炎症", ["炎症"], ["炎症"], "x"), ("炎症的机制", ["炎症"], ["炎症"], "x"), ("x", None, None, None)], "q string, a array<string>, l array<string>, c string")
    assert [r.v for r in b.select(L.introduction_bonus("q", "a", "l", "c").alias("v")).collect()] == [1.2, 0.0, 0.0]


def test_commands(spark):
    decisions = spark.createDataFrame([("d1", "merge", "n1", 0.5, False, None), ("d2", "merge", "n2", 0.5, None, None)], "id string, action string, result_name string, confidence double, teacher_override boolean, feedback string")
    commands = spark.createDataFrame([(1, "split", "d1", None, "first"), (2, "remove", "d1", None, "then"), (3, "merge", None, ["a", "b"], "join"), (4, "remove", "nope", None, "x"), (5, "keep", None, ["Cell"], "k"), (6, "split", None, None, "y")], "id int, operation string, decision_id string, targets array<string>, message string")
    got = {r.id: (r.action, r.teacher_override, r.feedback) for r in L.commands_applied(decisions, commands, "id").collect()}
    assert got == {"d1": ("remove", True, "then"), "d2": ("merge", False, None), "dec_teacher_3": ("merge", True, "join")}
    nodes = spark.createDataFrame([(1, "the cell wall"), (2, "gland"), (3, None)], "id int, name string")
    assert [r.id for r in L.locked_by(nodes, commands, "id", "name").collect()] == [1]


def test_shown_nodes(spark):
    rows = [("炎症", "core_concept", True), ("炎", "core_concept", False), ("3-5 cm", "core_concept", False), ("第一节 血管", "section_topic", True), ("注意炎症", "core_concept", False), ("炎症。", "core_concept", False), ("炎症", "chapter_topic", False), ("长" * 30, "section_topic", False)]
    d = spark.createDataFrame(rows, "l string, k string, want boolean")
    assert all(r.v == r.want for r in d.select("*", L.shown(F.col("l"), F.col("k")).alias("v")).collect())


def test_deep_levels_and_loops(spark):
    d = spark.createDataFrame([("g", i, lv) for i, lv in enumerate([1, 3, 9, 12, 10, 2, 9])], "g string, id int, level int")
    assert [r.parent for r in G.parent_of(d, ["g"], "id", "level", "id").orderBy("id").collect()] == [None, 0, 1, 2, 2, 0, 5]
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (0, 2), (None, 1), (5, 5)], "a int, b int")
    got = R.descendants(e, "a", "b")
    assert got.count() == 21 * 20 and got.where("root = 0 AND node = 20").first().depth == 19
