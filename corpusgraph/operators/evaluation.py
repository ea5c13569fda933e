"""How well questions are answered: expected concepts, the six measures of a suite, the six ratios of a course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Results that count for recall, and those that count as cited.
SHOWN, CITED = 8, 3
CONCEPTS = "array<struct<canonical:string,aliases:array<string>>>"


def expected(concepts: Column, terms: Column) -> Column:
    """The concepts (canonical, aliases) a question wants: its concepts, the canonical name among the aliases, else each of its terms."""
    named = F.transform(F.coalesce(concepts, F.array().cast(CONCEPTS)), lambda c: F.struct(
        F.trim(T.text(c["canonical"])).alias("canonical"),
        F.filter(F.transform(F.coalesce(c["aliases"], F.array().cast("array<string>")), lambda a: F.trim(T.text(a))), lambda a: a != "").alias("aliases"),
    ))
    full = F.filter(F.transform(named, lambda c: F.struct(
        c["canonical"].alias("canonical"), F.when(F.array_contains(c["aliases"], c["canonical"]), c["aliases"]).otherwise(F.concat(F.array(c["canonical"]), c["aliases"])).alias("aliases"),
    )), lambda c: c["canonical"] != "")
    plain = F.transform(F.array_distinct(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))), lambda t: F.struct(t.alias("canonical"), F.array(t).alias("aliases")))
    return F.when(F.size(F.coalesce(concepts, F.array().cast(CONCEPTS))) > 0, full).otherwise(plain)


def stands(concepts: Column, content: Column, path: Column) -> Column:
    """Canonical names of the concepts, one of whose names stands in a passage or the headings above it, white space and case aside."""
    said = T.normalize_evidence(F.concat_ws(" ", T.text(content), F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ")))
    return F.array_distinct(F.transform(F.filter(concepts, lambda c: F.exists(c["aliases"], lambda a: said.contains(T.normalize_evidence(a)))), lambda c: c["canonical"]))


def wanted(n: Column) -> Column:
    """How many of ``n`` concepts must be covered: one or both of up to two, three fifths (rounded up) of more."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.floor((n * 3 + 4) / 5))).cast("int")


def judged(questions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """A row for each question: what was covered, cited and refused.

    ``questions``: key, answerable, mode, concepts, terms, chapter_id, chapter_title,
    min_books; ``results``: key, rank, id, book, chapter_id, chapter, content, path,
    page_start, page_end.  Questions without results are there too."""
    # what is joined from the questions is a stated set's parts, one row each
    q = questions.select(key, "answerable", "mode", "chapter_id", "chapter_title", "min_books", expected(F.col("concepts"), F.col("terms")).alias("concepts"))
    r = results.where(F.col("rank") <= SHOWN).withColumnRenamed("chapter_id", "_chapter_id")
    j = r.join(q, key)
    hit = stands(F.col("concepts"), F.col("content"), F.col("path"))
    targeted = F.coalesce(F.col("chapter_id") != "", F.lit(False))
    inside = F.coalesce((F.col("_chapter_id") == F.col("chapter_id")) | (F.col("chapter") == F.col("chapter_title")), F.lit(False))
    paged = F.coalesce((F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start")) & (T.text(F.col("id").cast("string")) != ""), F.lit(False))
    j = j.withColumns({"_hit": hit, "_inside": inside}).withColumn("_good", paged & (F.size("_hit") > 0) & (~targeted | inside))
    names = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  at most SHOWN rows
    per = j.groupBy(key).agg(
        F.count("*").alias("n_shown"), F.size(names(F.col("_hit"))).alias("n_covered"), F.size(names(F.when(F.col("_inside"), F.col("_hit")))).alias("n_covered_inside"),
        F.count_if((F.col("rank") <= CITED) & F.col("_good")).alias("n_cited_right"), F.count_if(F.col("rank") <= CITED).alias("n_cited"),
        F.count_distinct(F.when(F.size("_hit") > 0, F.col("book"))).alias("n_books"),
    )
    got = q.join(per, key, "left").na.fill(0, ["n_shown", "n_covered", "n_covered_inside", "n_cited_right", "n_cited", "n_books"])
    need = wanted(F.size("concepts"))
    in_chapter = F.when(F.coalesce(F.col("chapter_id") != "", F.lit(False)), F.col("n_covered_inside") >= need)
    yes = F.col("answerable")
    return got.select(
        key, "answerable", "mode", "chapter_id",
        F.when(yes, (F.col("n_covered") >= need) & F.coalesce(in_chapter, F.lit(True))).alias("retrieval_hit"),
        F.when(yes, in_chapter).alias("chapter_hit"),
        F.when(yes, F.col("n_cited_right")).otherwise(0).alias("citation_hits"), F.when(yes, F.col("n_cited")).otherwise(0).alias("citation_count"),
        F.when(yes & (F.col("mode") == "compare"), F.col("n_books") >= F.coalesce("min_books", F.lit(2))).alias("compare_hit"),
        F.when(~yes, F.col("n_shown") == 0).alias("rejected"),
    )


def ratio_rows(rows: DataFrame, ratios: dict[str, tuple[Column, Column]]) -> DataFrame:
    """metric, numerator, denominator, ratio (four places, 0 of nothing) of aggregate pairs over ``rows``, in one pass."""
    sums = rows.agg(*(c.cast("long").alias(f"{name}_{end}") for name, pair in ratios.items() for end, c in zip("nd", pair, strict=True)))
    listed = F.array(*(F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(f"{name}_n"), F.lit(0)).alias("numerator"), F.coalesce(F.col(f"{name}_d"), F.lit(0)).alias("denominator")) for name in ratios))
    out = sums.select(F.explode(listed).alias("m")).select("m.*")
    return out.withColumn("ratio", F.coalesce(F.round(F.try_divide(F.col("numerator"), F.col("denominator")), 4), F.lit(0.0)))


def measures(per_question: DataFrame) -> DataFrame:
    """The six measures of a suite over ``judged`` questions."""
    c, yes = F.col, F.coalesce(F.col("answerable"), F.lit(False))
    chaptered = F.when(c("chapter_hit").isNotNull(), c("chapter_id"))
    return ratio_rows(per_question, {
        "retrieval_recall": (F.count_if(c("retrieval_hit")), F.count_if(yes)),
        "citation_precision": (F.sum("citation_hits"), F.sum("citation_count")),
        "cross_book_coverage": (F.count_if(c("compare_hit")), F.count_if(c("compare_hit").isNotNull())),
        "refusal": (F.count_if(c("rejected")), F.count_if(~yes)),
        "chapter_question_hit": (F.count_if(c("chapter_hit")), F.count_if(c("chapter_hit").isNotNull())),
        "chapter_coverage": (F.count_distinct(F.when(c("chapter_hit"), c("chapter_id"))), F.count_distinct(chaptered)),
    })


def scorecard(chapters: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, candidates: DataFrame, samples: DataFrame, structural: tuple[str, ...]) -> DataFrame:
    """The six structural ratios of a course.

    ``chapters`` review_status; ``chunks`` page_start, page_end; ``nodes`` granularity,
    evidence_status, source_paragraph; ``edges`` id, relation; ``evidence`` edge_id,
    quote_verified; ``candidates`` status; ``samples`` hit (whether a sampled concept
    found its own source among the first five)."""
    c = F.col
    proven = evidence.where("quote_verified").select(c("edge_id").alias("id")).distinct().withColumn("_proven", F.lit(True))
    meant = edges.where(~c("relation").isin(*structural)).join(proven, "id", "left")
    core = nodes.where("granularity = 'core_concept'")
    parts = [
        ratio_rows(chapters, {"chapters_confirmed": (F.count_if(c("review_status") == "confirmed"), F.count("*"))}),
        ratio_rows(chunks, {"pages_traceable": (F.count_if((c("page_start") > 0) & (c("page_end") >= c("page_start"))), F.count("*"))}),
        ratio_rows(core, {"core_evidence": (F.count_if((c("evidence_status") == "verified") & (T.text("source_paragraph") != "")), F.count("*"))}),
        ratio_rows(meant, {"relation_evidence": (F.count_if(c("_proven")), F.count("*"))}),
        ratio_rows(candidates, {"candidates_reviewed": (F.count_if(c("status").isin("approved", "rejected")), F.count("*"))}),
        ratio_rows(samples, {"source_hit_at_5": (F.count_if(c("hit")), F.count("*"))}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
