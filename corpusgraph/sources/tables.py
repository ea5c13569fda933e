"""Scans and sinks: tables, whole files by format, pages of HTML, question suites, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Formats that can be read, by extension; anything else becomes an error row.
TEXT_FORMATS = ("md", "txt", "markdown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each file: path, title, format, text, warning, error.

    Text files are one physical page, with a warning; other formats give an
    error row and do not stop the others."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = kind.isin(*TEXT_FORMATS)
    return files.select(
        "path",
        T.title_of_file("path").alias("title"),
        kind.alias("format"),
        F.when(known, F.decode("content", "UTF-8")).alias("text"),
        F.when(known, F.lit("no page boundaries: the whole file is page 1")).alias("warning"),
        F.when(~known, F.concat(F.lit("unsupported format: "), kind)).alias("error"),
    )


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles or tags; common entities decoded; blanks squeezed."""
    c = F.regexp_replace(T.text(html), r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return T.blank_runs(c)


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, heading (the first h1), text."""
    heading = F.regexp_extract(T.text("html"), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return pages.select("page_id", "url", html_text(heading).alias("heading"), html_text(F.col("html")).alias("text"))


def page_statistics(pages: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """n_pages, n_empty, n_repaired (pages with broken characters), n_broken (such characters), needs_ocr (three tenths or more are empty)."""
    broken = F.regexp_count(T.text(text), F.lit(T.BROKEN))
    out = pages.groupBy(*by).agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.trim(T.text(text)) == "").alias("n_empty"),
        F.count_if(broken > 0).alias("n_repaired"),
        F.coalesce(F.sum(broken), F.lit(0)).cast("long").alias("n_broken"),
    )
    return out.withColumn("needs_ocr", F.coalesce(F.try_divide("n_empty", "n_pages") >= 0.3, F.lit(False)))


def question_suite(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file (an array, or an object that holds one under ``questions``)."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("questions").alias("q")).select("q.*") if "questions" in raw.columns else raw


def first_uploads(files: DataFrame, scope: list[str], content: str, order: list[str]) -> DataFrame:
    """Every row with its content hash and whether it is the first of its content within ``scope`` (by ``order``)."""
    hashed = files.withColumn("content_hash", F.sha2(T.text(content), 256))
    window = Window.partitionBy(*scope, "content_hash").orderBy(*order)
    return hashed.withColumn("accepted", F.row_number().over(window) == 1)


def upsert(target: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows by key; a change with the largest ``version`` replaces what was there, one version included."""
    old = target.withColumn("_rank", F.lit(0)).withColumn("_version", F.lit(None).cast(changes.schema[version].dataType))
    new = changes.withColumn("_rank", F.lit(1)).withColumn("_version", F.col(version))
    window = Window.partitionBy(*key).orderBy(F.desc("_rank"), F.desc_nulls_last("_version"))
    both = old.unionByName(new, allowMissingColumns=True).withColumn("_n", F.row_number().over(window))
    return both.where("_n = 1").drop("_n", "_rank", "_version")


def cascade_delete(root: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, str, str]]) -> dict[str, DataFrame]:
    """What is left of a tree of tables when the ``gone`` keys of ``root`` go.

    ``children``: name -> (table, its key, its parent's name or "root", foreign key), parents first."""
    dead = {"root": gone.select(F.col(key).alias("_dead")).distinct()}
    kept = {"root": root.join(dead["root"], root[key] == F.col("_dead"), "left_anti")}
    for name, (frame, own, parent, foreign) in children.items():
        hit = frame.join(dead[parent], frame[foreign] == F.col("_dead"), "left_semi")
        dead[name] = hit.select(F.col(own).alias("_dead")).distinct()
        kept[name] = frame.join(dead[parent], frame[foreign] == F.col("_dead"), "left_anti")
    return kept


def markdown_report(rows: DataFrame, title: str, heading: str, body: str, order: list[str]) -> DataFrame:
    """One row ``report``: a title, and a section for each row, with markup in the values neutralised."""
    section = F.concat(F.lit("## "), T.escape_markdown(heading), F.lit("\n\n"), T.escape_markdown(body))
    listed = F.array_sort(F.collect_list(F.struct(*order, section.alias("_section"))))
    return rows.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(listed, lambda s: s["_section"]), "\n\n")).alias("report"))
