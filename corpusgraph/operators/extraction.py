"""Facts by rule from sections: topics, definitions, review states, canonical concepts; evaluation of coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def definitions(rows: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """key, name, definition, quote: sentences of the forms X 是指 Y, X 定义为 Y, X is defined as Y, X refers to Y; at most ``most`` for each key."""
    form = r"^(?:所谓)?(.{2,40}?)(?:是指|定义为|\s+[iI]s defined as|\s+[rR]efers to)[，,:：]?\s*(.{4,})$"
    s = rows.select(key, F.posexplode(F.split(T.text(text), r"[。！？!?\n]|\.\s")).alias("_i", "_s")).withColumn("_s", F.trim("_s"))
    got = s.select(key, "_i", F.trim(F.regexp_extract("_s", form, 1)).alias("name"), F.trim(F.regexp_extract("_s", form, 2)).alias("definition"), F.col("_s").alias("quote"))
    # a sentence that says what something is not, or that points back, defines nothing
    got = got.where((F.col("name") != "") & ~F.col("name").rlike("不|非|^(?:这|此|该|其|它|[tT]his|[iI]t|[tT]hat)"))
    w = Window.partitionBy(key).orderBy("_i")
    return got.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k", "_i")


def topics(sections: DataFrame, key: str, order: str, heading: str, content: str, most: int = 8) -> DataFrame:
    """key, topic, definition: the first ``most`` sections that have a meaningful heading, each with its first meaningful sentence."""
    w = Window.partitionBy(key).orderBy(order)
    good = sections.where((F.trim(T.text(heading)) != "") & ~T.is_front_matter(heading))
    top = good.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return top.select(key, T.clean_concept_name(heading).alias("topic"), T.excerpt(content).alias("definition"))


def review_status(method: Column, verified: Column, confidence: Column) -> Column:
    """Only what a model extracted, with verified evidence and three quarters of confidence, needs no review."""
    sure = (method == "model") & F.coalesce(verified, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= 0.75)
    return F.when(sure, "auto_verified").otherwise("needs_review")


def approvals(candidates: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """What approving an equivalence does to the canonical concepts of its ends: none, adopt, create or conflict (which stays pending)."""
    side = lambda end: nodes.select(F.col(key).alias(end), F.col("canonical").alias(f"_{end}"))
    j = candidates.join(side("a"), "a", "left").join(side("b"), "b", "left")
    effect = (
        F.when(F.col("relation") != "equivalent_to", "none").when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")), "conflict")
        .when(F.col("_a").isNull() & F.col("_b").isNull(), "create").when(F.col("_a").isNull() | F.col("_b").isNull(), "adopt").otherwise("none")
    )
    return j.select("a", "b", "relation", effect.alias("effect"), F.coalesce("_a", "_b").alias("canonical"))


def required_matches(n_expected: Column) -> Column:
    """How many of a question's concepts must be found: one of one, two of two, else three fifths (two at least)."""
    return F.when(n_expected <= 2, n_expected).otherwise(F.greatest(F.lit(2), F.ceil(n_expected * 3 / 5))).cast("int")


def without_repeats(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Result pages merged: the first row of each key in the order of arrival, with its place."""
    w = Window.partitionBy(key).orderBy(*order)
    one = pages.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return one


def shared_claims(claims: DataFrame, citations: DataFrame, claim: str, book: str) -> DataFrame:
    """Adds ``place``: a claim that fewer than two books back goes to the sequence, its content kept."""
    books = citations.groupBy(claim).agg(F.countDistinct(book).alias("n_books"))
    j = claims.join(books, claim, "left").withColumn("n_books", F.coalesce("n_books", F.lit(0)))
    return j.withColumn("place", F.when(F.col("n_books") >= 2, "common").otherwise("sequence"))


def supplement(ranked: DataFrame, lexical: DataFrame, query: str, book: str, wanted: DataFrame, top: int = 60, score: str = "score", key: str = "id") -> DataFrame:
    """For each wanted (query, book) that the first ``top`` ranks lack, the book's best passage from ``lexical``."""
    have = ranked.where(F.col("rank") <= top).select(query, book).distinct()
    missing = wanted.join(have, [query, book], "left_anti")
    w = Window.partitionBy(query, book).orderBy(F.desc(score), key)
    return lexical.join(missing, [query, book], "left_semi").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
