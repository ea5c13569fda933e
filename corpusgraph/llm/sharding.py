"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source, and the row of rank ``r``
of ``n`` gets the fractional rank ``(r - u) / n``, where ``u`` between 0 and 1 is
the source's own.  In the order of fractional ranks every stretch has the
mixture of the whole table, so equal cuts of that order are shards with the same
mixture and counts at most one apart; sources of one row are spread by their ``u``.

No rank is counted in one task: a uniform hash deals the rows of each source
(and fractional ranks deal all rows) into buckets of bounded size, ranks are
counted inside a bucket, and prefix sums over the bucket counts are added, in two
levels.  A source with a third of all rows just has more buckets.  The hash is of
id, text and size, so places do not hang on how the input is cut; only where equal
rows crowd a bucket, its rows are dealt anew by where they were written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that one bucket holds on average; how many times as many crowd it; buckets whose counts are summed in one group.
BUCKET_ROWS, CROWDED, GROUP = 1000, 8, 1024


def _part(c: Column) -> Column:
    """A number from 0 to 1 (not itself) of a hexadecimal hash: its first 13 digits."""
    return F.conv(F.substring(c, 1, 13), 16, 10).cast("double") / 2.0**52


def _before(counts: DataFrame, by: list[str], at: str) -> DataFrame:
    """``counts`` (by, at: long, n) with ``before``: the sum of ``n`` over smaller ``at``; groups of GROUP neighbours first, then inside them."""
    group = F.expr(f"{at} div {GROUP}").alias("_group")
    sums = counts.groupBy(*by, group).agg(F.sum("n").alias("_n"))
    run = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_group", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("*", group).withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(sums, [*by, "_group"]).select(*by, at, (F.col("_ahead") + F.col("_inside")).alias("before"))


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, shard, slot for each row of ``docs`` (doc_id, text, source).

    ``size`` is the UTF-8 length plus 16.  Shards differ by at most one row, and
    ``slot`` counts from 0 without gaps in each shard.  A null text has no bytes,
    null and empty sources form one stratum, null and repeated ids and repeated
    rows are placed one by one, fewer rows than shards leave shards empty, and an
    empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.monotonically_increasing_id().alias("row"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    # once written, a row keeps its number
    rows = written(rows.withColumn("shuffled", key), "shard-rows")
    total = rows.count()
    buckets = 1 << max(0, (total // BUCKET_ROWS).bit_length())
    dealt = lambda df: df.withColumn("bucket", F.floor(_part(F.col("shuffled")) * buckets).cast("long"))
    rows = dealt(rows)
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    crowded = counts.where(F.col("n") > CROWDED * BUCKET_ROWS).select("source", "bucket", F.lit(True).alias("anew"))
    if not crowded.isEmpty():
        anew = F.md5(F.concat_ws(":", "shuffled", F.col("row").cast("string")))
        rows = rows.join(crowded, ["source", "bucket"], "left").withColumn("shuffled", F.when(F.col("anew"), anew).otherwise(F.col("shuffled")))
        rows = written(dealt(rows.drop("anew", "bucket")), "shard-rows")
        counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    whole = counts.groupBy("source").agg(F.sum("n").alias("of"))
    counts = _before(counts, ["source"], "bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled", "row")
    ranked = rows.withColumn("k", F.row_number().over(inside)).join(counts, ["source", "bucket"]).join(whole, "source")
    own = _part(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("source"), F.col("source"))))
    fraction = (F.col("before") + F.col("k") - own) / F.col("of")
    ranked = ranked.select("doc_id", "size", "text_crc32", "source", "shuffled", "row", fraction.alias("fraction"))
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1)))

    ranked = written(ranked, "shard-ranks")
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    cells = _before(cells, ["all"], "cell").drop("all")
    inside = Window.partitionBy("cell").orderBy("fraction", "source", "shuffled", "row")
    placed = ranked.withColumn("k", F.row_number().over(inside)).join(cells, "cell").withColumn("place", F.col("before") + F.col("k") - 1)
    shard = F.expr(f"cast((place * {n_shards}) div {max(total, 1)} as int)")
    # the first place of shard s is ceil(s * total / n)
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "source", "fraction", "shard", (F.col("place") - first).alias("slot"))
