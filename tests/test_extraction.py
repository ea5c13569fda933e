"""Rule extraction, approvals, supplements and identity keys on hand rows."""

from pyspark.sql import functions as F

from corpusgraph.functions import keys as K
from corpusgraph.operators import extraction as X


def test_definitions_and_topics(spark):
    d = spark.createDataFrame([(1, "坏死是指细胞的不可逆死亡。它是指别的东西。Osmosis is defined as movement of water. 这不是定义"), (2, None)], "k int, t string")
    got = {(r.k, r.name): r.definition for r in X.definitions(d, "k", "t").collect()}
    assert got == {(1, "坏死"): "细胞的不可逆死亡", (1, "Osmosis"): "movement of water"}
    s = spark.createDataFrame([(1, 0, "目录", "x"), (1, 1, "第一节 损伤......3", "损伤是一个过程，它有许多不同的原因和机制表现。后文"), (1, 2, "", "y")], "k int, o int, h string, c string")
    (r,) = X.topics(s, "k", "o", "h", "c").collect()
    assert r.topic == "损伤" and r.definition.startswith("损伤是一个过程")


def test_approvals_and_counts(spark):
    nodes = spark.createDataFrame([("x", "c1"), ("y", "c2"), ("z", None), ("w", None)], "id string, canonical string")
    c = spark.createDataFrame([("x", "y", "equivalent_to"), ("x", "z", "equivalent_to"), ("z", "w", "equivalent_to"), ("x", "y", "related_to")], "a string, b string, relation string")
    assert {(r.a, r.b, r.relation): r.effect for r in X.approvals(c, nodes).collect()} == {("x", "y", "equivalent_to"): "conflict", ("x", "z", "equivalent_to"): "adopt", ("z", "w", "equivalent_to"): "create", ("x", "y", "related_to"): "none"}
    n = spark.range(1, 8).select(X.required_matches(F.col("id")).alias("n"))
    assert [r.n for r in n.collect()] == [1, 2, 2, 3, 3, 4, 5]
    status = spark.createDataFrame([("model", True, 0.8), ("model", True, 0.7), ("rule", True, 0.9), ("model", None, 0.9)], "m string, v boolean, c double")
    assert [r.s for r in status.select(X.review_status(F.col("m"), F.col("v"), F.col("c")).alias("s")).collect()] == ["auto_verified"] + ["needs_review"] * 3


def test_supplement_and_claims(spark):
    ranked = spark.createDataFrame([(1, "A", 1), (1, "B", 61)], "q int, book string, rank int")
    lexical = spark.createDataFrame([(1, "B", "b1", 2.0), (1, "B", "b2", 3.0), (1, "A", "a1", 9.0)], "q int, book string, id string, score double")
    wanted = spark.createDataFrame([(1, "A"), (1, "B")], "q int, book string")
    assert [r.id for r in X.supplement(ranked, lexical, "q", "book", wanted).collect()] == ["b2"]
    claims = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "c int, t string")
    cites = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A")], "c int, book string")
    assert {r.c: r.place for r in X.shared_claims(claims, cites, "c", "book").collect()} == {1: "common", 2: "sequence", 3: "sequence"}
    pages = spark.createDataFrame([("a", 2, "later"), ("a", 1, "first"), ("b", 3, "x")], "id string, at int, v string")
    assert {r.id: r.v for r in X.without_repeats(pages, "id", ["at"]).collect()} == {"a": "first", "b": "x"}


def test_keys(spark):
    d = spark.createDataFrame([("第三节　Ｃell（细胞） Wall",), (None,)], "t string")
    got = d.select(K.compact("t").alias("c"), K.label("t").alias("l"), K.topic_key("t").alias("k")).collect()
    assert tuple(got[0]) == ("第三节cell(细胞)wall", "Cell(细胞) Wall", "cellwall") and tuple(got[1]) == ("", "", "")
    p = spark.createDataFrame([(["Book", "第一节 损伤"], "x"), (["Other", "损伤"], "y"), ([], "a body sentence that is long enough. More")], "path array<string>, c string")
    keys = [r.k for r in p.select(K.heading_key(F.col("path"), F.col("c")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[2]) == 24
