"""Pages to headings and chapters, and the quality gates of what is extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Heading forms, kinds of nodes and edges, the title and length of an introduction.
HEADING = rf"^(?:第[ \t]*[{T.NUMERALS}0-9０-９]+[ \t]*章[ \t]*.*|(?i:chapter)[ \t]+[0-9]+[ \t]*.*|#{{1,2}}[ \t]+.+)$"
CONCEPT_TYPES = ("concept", "definition", "principle", "process", "formula", "method", "example", "condition", "exception")
STRUCTURAL = ("contains", "part_of", "example_of")
SEMANTIC = ("prerequisite", "causes", "contrasts_with", "equivalent_to", "applies_to", "supports", "conflicts_with", "related_to")
INTRODUCTION, LEAST_INTRODUCTION = "绪论/前言", 200


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line, start (offset of the line in the text)."""
    split = docs.select(key, F.posexplode(F.split(T.text(text), "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return split.select(key, (F.col("i") + 1).alias("line_no"), "line", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("start"))


def valid_heading(title: Column) -> Column:
    """Whether a chapter line is a heading and not a sentence that starts with a chapter's number."""
    value = T.blank_runs(title)
    numbered = value.rlike(rf"^第 *[{T.NUMERALS}0-9]+ *章")
    rest = F.trim(F.regexp_replace(value, rf"^第 *[{T.NUMERALS}0-9]+ *章", ""))
    bare = F.trim(F.regexp_replace(rest, r"(?:\.{4,}|…{2,}).*$", ""))
    good = ~F.substring(rest, 1, 1).isin(*"）)】]。，,；;！？") & F.length(bare).between(1, 40) & ~bare.rlike("[。！？；;]")
    return ~numbered | (rest == "") | good


def heading_marks(rows: DataFrame, key: str, extra: str | None = None) -> DataFrame:
    """Lines that are headings: key, line_no, start, level, title, identity."""
    line = F.col("line")
    hit = line.rlike(HEADING)
    if extra:
        hit = hit | line.rlike(extra)
    title = F.trim(F.regexp_replace(line, "^#+", ""))
    marks = rows.where(hit).select(key, "line_no", "start", F.when(line.startswith("## "), 2).otherwise(1).alias("level"), title.alias("title"))
    return marks.where(valid_heading(F.col("title"))).withColumn("identity", chapter_identity(F.col("title")))


def chapter_identity(title: Column) -> Column:
    bare = F.regexp_replace(T.text(title), r"\s+", "")
    zh = F.regexp_extract(bare, rf"^第([{T.NUMERALS}0-9]+)章", 1)
    en = F.regexp_extract(F.lower(bare), r"^chapter([0-9]+)", 1)
    return F.when(zh != "", F.concat(F.lit("zh:"), zh)).when(en != "", F.concat(F.lit("en:"), en)).otherwise(F.lower(bare))


def chapter_number(identity: Column) -> Column:
    return F.when(identity.rlike("^(?:zh|en):"), T.numeral(F.substring(identity, 4, 100)))


def without_contents(marks: DataFrame, key: str) -> DataFrame:
    """Marks without a table of contents and without running headers.

    If chapter 1 comes again and a chapter 2 follows it, the list starts there;
    of each identity the first mark stays, with its longest title."""
    w = Window.partitionBy(key).orderBy("line_no")
    number = chapter_number(F.col("identity"))
    m = marks.withColumn("_no", number).withColumn("_ones", F.sum((F.col("_no") == 1).cast("int")).over(w))
    later = F.max(F.when(F.col("_no") == 2, F.col("line_no"))).over(Window.partitionBy(key))
    m = m.withColumn("_later", later)
    starts = m.groupBy(key).agg(F.min(F.when((F.col("_no") == 1) & (F.col("_ones") > 1) & (F.col("_later") > F.col("line_no")), F.col("line_no"))).alias("_from"))
    m = m.join(starts, key).where(F.col("_from").isNull() | (F.col("line_no") >= F.col("_from")))
    own = Window.partitionBy(key, "identity")
    m = m.withColumn("title", F.max_by("title", F.struct(F.length("title"), -F.col("line_no"))).over(own)).withColumn("_n", F.row_number().over(own.orderBy("line_no")))
    return m.where("_n = 1").drop("_n", "_no", "_ones", "_later", "_from")


def chapters(marks: DataFrame, texts: DataFrame, key: str, text: str, least: int = 50, every_mark: DataFrame | None = None) -> DataFrame:
    """key, order_index, title, start, stop, content: what stands between a mark and the next; bodies under ``least`` characters go.

    With ``every_mark`` (the marks before a table of contents was taken out), a text
    of over LEAST_INTRODUCTION characters ahead of the first mark is a chapter of
    its own, unless a table of contents stood there."""
    w = Window.partitionBy(key).orderBy("line_no")
    own = texts.select(key, F.col(text).alias("_text"))
    spans = marks.withColumn("_next", F.lead("start").over(w)).join(own, key)
    spans = spans.select(key, "line_no", "title", "start", F.coalesce("_next", F.length("_text")).alias("stop"), "_text", F.lit(least).alias("_least"))
    if every_mark is not None:
        first = marks.groupBy(key).agg(F.min_by("start", "line_no").alias("stop"), F.min("line_no").alias("_kept"))
        opened = first.join(every_mark.groupBy(key).agg(F.min("line_no").alias("_first")), key).where("_kept = _first").join(own, key)
        spans = spans.unionByName(opened.select(key, F.lit(0).cast(marks.schema["line_no"].dataType).alias("line_no"), F.lit(INTRODUCTION).alias("title"), F.lit(0).cast(marks.schema["start"].dataType).alias("start"), "stop", "_text", F.lit(LEAST_INTRODUCTION + 1).alias("_least")))
    content = T.clean_text(F.substring(F.col("_text"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")))
    cut = spans.select(key, "line_no", "title", "start", "stop", content.alias("content"), "_least")
    return cut.where(F.length("content") >= F.col("_least")).withColumn("order_index", F.row_number().over(w) - 1).drop("line_no", "_least")


def page_groups(pages: DataFrame, book: str, page: str, text: str, least: int = 50) -> DataFrame:
    """Books without headings: runs of pages, a tenth of the book (rounded up, 1 to 10 pages) each."""
    whole = Window.partitionBy(book)
    n = F.count("*").over(whole)
    size = F.greatest(F.lit(1), F.least(F.lit(10), F.floor((n + 9) / 10)))
    rows = pages.withColumn("_group", F.floor((F.row_number().over(whole.orderBy(page)) - 1) / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text])
    out = rows.groupBy(book, "_group").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_join(listed, "\n\n").alias("content"))
    return out.where(F.length("content") >= least).drop("_group")


def page_spans(pages: DataFrame, chapter: str, page: str, text: str) -> DataFrame:
    """chapter, page, start, stop: where each page lies in its chapter, pages joined by an empty line."""
    w = Window.partitionBy(chapter).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 2).over(w), F.lit(0))
    return pages.select(chapter, page, start.alias("start"), (start + F.length(text)).alias("stop"))


def node_gate(name: Column, definition: Column, kind: Column, quote: Column, source: Column) -> Column:
    """Struct score, flags, accepted, verified of an extracted node."""
    n, d, q = F.trim(T.text(name)), F.trim(T.text(definition)), F.trim(T.text(quote))
    verified = T.quote_exists(q, source)
    noise = F.lit(False)
    for p in T.NOISE:
        noise = noise | n.rlike(p)
    rules = [
        ("invalid_name_length", ~F.length(n).between(2, 80), 0.35, True),
        ("noise_term", noise, 0.5, True),
        ("front_matter", T.is_front_matter(n), 1.0, True),
        ("sentence_as_name", (F.length(n) > 42) | n.rlike("[。！？；]") | (F.regexp_count(n, F.lit("，")) >= 2), 0.5, True),
        ("definition_too_short", F.length(d) < 8, 0.2, False),
        ("definition_repeats_name", T.normalize_evidence(d) == T.normalize_evidence(n), 0.3, False),
        ("unknown_concept_type", ~kind.isin(*CONCEPT_TYPES), 0.1, False),
        ("missing_source_quote", q == "", 0.35, True),
        ("broken_source_quote", (q != "") & T.has_broken_text(q), 1.0, True),
        ("source_quote_not_found", (q != "") & ~T.has_broken_text(q) & ~verified, 0.35, True),
    ]
    return _judged(rules, 0.45, verified)


def _judged(rules: list[tuple[str, Column, float, bool]], least: float, verified: Column) -> Column:
    score, fatal = F.lit(1.0), F.lit(False)
    for _, hit, weight, hard in rules:
        score = score - F.when(hit, weight).otherwise(0.0)
        if hard:
            fatal = fatal | hit
    flags = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit, _, _ in rules)))
    rounded = F.round(score, 4)
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded)).alias("score"), flags.alias("flags"), (~fatal & (rounded >= least)).alias("accepted"), verified.alias("verified"))


def edge_gate(source: Column, target: Column, relation: Column, known: Column, quote: Column, text: Column) -> Column:
    """Struct score, flags, accepted, verified of an extracted edge; structural relations need no quote."""
    q = F.trim(T.text(quote))
    semantic, found = relation.isin(*SEMANTIC), T.quote_exists(q, text)
    rules = [
        ("self_loop", source == target, 1.0, False),
        ("unknown_endpoint", ~known, 1.0, False),
        ("unsupported_relation", ~relation.isin(*STRUCTURAL, *SEMANTIC), 1.0, False),
        ("missing_relation_evidence", semantic & (q == ""), 0.6, False),
        ("relation_evidence_not_found", semantic & (q != "") & ~found, 0.6, False),
    ]
    return _judged(rules, 0.5, relation.isin(*STRUCTURAL) | (semantic & found))
