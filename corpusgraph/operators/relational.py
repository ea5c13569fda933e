"""Joins, set tests, aggregates and paging that the reads are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def edges_of_nodes(edges: DataFrame, nodes: DataFrame, source: str, node: str) -> DataFrame:
    """Edges that start in ``nodes``."""
    return edges.join(nodes.select(F.col(node).alias("_n")), F.col(source) == F.col("_n"), "left_semi")


def edges_inside(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select(F.col(node).alias("_n"))
    return edges.join(ids, F.col(source) == F.col("_n"), "left_semi").join(ids, F.col(target) == F.col("_n"), "left_semi")


def edges_touching(edges: DataFrame, nodes: DataFrame, key: list[str], source: str, target: str, node: str) -> DataFrame:
    """Edges with either end in ``nodes``: two equi-joins and their union, never a nested loop."""
    ids = nodes.select(F.col(node).alias("_n"))
    hits = edges.join(ids, F.col(source) == F.col("_n"), "left_semi").unionByName(edges.join(ids, F.col(target) == F.col("_n"), "left_semi"))
    return hits.dropDuplicates(key)


def neighbours(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, other: each edge from both of its ends, loops once."""
    there = edges.select(F.col(source).alias("node"), F.col(target).alias("other"))
    back = edges.where(F.col(source) != F.col(target)).select(F.col(target).alias("node"), F.col(source).alias("other"))
    return there.unionByName(back)


def with_pair(pairs: DataFrame, nodes: DataFrame, key: str, left: str, right: str, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of the node at either end, null where it is missing."""
    side = lambda end: nodes.select(F.col(key).alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    return pairs.join(side(left), left, "left").join(side(right), right, "left")


def contained_in(groups: DataFrame, members: DataFrame, key: str, member: str, scope: str) -> DataFrame:
    """Keys of ``groups`` (key, member) all of whose members are in ``members`` (scope): division by anti-join."""
    outside = groups.join(members.select(F.col(scope).alias("_m")), F.col(member) == F.col("_m"), "left_anti").select(F.col(key).alias("_k")).distinct()
    return groups.select(key).distinct().join(outside, F.col(key) == F.col("_k"), "left_anti")


def group_stats(rows: DataFrame, keys: list[str], unknown: str = "unknown") -> DataFrame:
    """dimension, value, n: counts by each key and the total, in one pass over grouping sets; null counts as ``unknown``."""
    named = rows.select(*(F.coalesce(F.col(k).cast("string"), F.lit(unknown)).alias(k) for k in keys))
    sets = [[F.col(k)] for k in keys] + [[]]
    counted = named.groupingSets(sets, *keys).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    dimension = F.coalesce(*(F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys), F.lit("total"))
    value = F.coalesce(*(F.when(F.col(f"_{k}") == 0, F.col(k)) for k in keys), F.lit("all"))
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of ``rows`` with the total, its rank, and whether more rows follow; late columns should be joined after it."""
    total = rows.agg(F.count("*").alias("total"))
    # one row
    got = rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    return got.withColumn("has_more", F.col("total") > offset + limit)


def best_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be total."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def modal_value(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the longest, then to the first in order."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    return best_by(counted, key, [F.desc("n"), F.desc(F.length(value)), F.col(value)])


def reconcile(existing: DataFrame, found: DataFrame, left: str, right: str) -> DataFrame:
    """a, b, action for unordered pairs: create those only found, refresh those in both, retire those only existing and pending.

    ``existing`` also has ``status``; a decided pair that is not found again is kept."""
    unordered = lambda d: d.withColumns({"a": F.least(left, right), "b": F.greatest(left, right)})
    old = unordered(existing).groupBy("a", "b").agg(F.max("status").alias("status"))
    new = unordered(found).select("a", "b", F.lit(True).alias("found")).distinct()
    action = F.when(F.col("status").isNull(), "create").when(F.col("status") != "pending", "keep").when(F.col("found"), "refresh").otherwise("retire")
    return old.join(new, ["a", "b"], "full_outer").select("a", "b", action.alias("action"))


def descendants(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """root, node, depth: every node below every parent once, with its least depth; loops end where nothing new is found.

    Rounds over the frontier of the round before, each written; a pair is followed once, however many ways lead to it."""
    step = edges.select(F.col(parent).alias("_up"), F.col(child).alias("_down")).where("_up IS NOT NULL AND _down IS NOT NULL").distinct()
    found = frontier = settled(step.where("_up <> _down").select(F.col("_up").alias("root"), F.col("_down").alias("node"), F.lit(1).alias("depth")))
    while not frontier.isEmpty():
        on = frontier.join(step, F.col("node") == F.col("_up")).where("_down <> root").select("root", F.col("_down").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = settled(on.join(found.select("root", "node"), ["root", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def band(rows: DataFrame, key: list[str], position: str, flag: Column, reach: int = 2) -> DataFrame:
    """``rows`` with ``near``: whether a flagged row of the same key lies within ``reach`` positions; a window, not a band join."""
    window = Window.partitionBy(*key).orderBy(position).rangeBetween(-reach, reach)
    return rows.withColumn("near", F.coalesce(F.max(flag.cast("int")).over(window), F.lit(0)) == 1)


def overlaps(left: DataFrame, right: DataFrame, key: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap: an equi-join on the cells of ``width`` that both touch.

    A pair is kept in the first cell they share, so it comes once."""
    cells = lambda x, y: F.sequence(F.floor(F.col(x) / width), F.floor((F.greatest(F.col(y) - 1, F.col(x))) / width))
    one = left.withColumn("_cell", F.explode(cells(*a)))
    two = right.withColumn("_cell", F.explode(cells(*b)))
    both = one.join(two, [*key, "_cell"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    return both.where(F.col("_cell") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)).drop("_cell")


def common_prefix(rows: DataFrame, key: list[str], path: str) -> DataFrame:
    """The longest common beginning of the paths (arrays) of each key.

    Levels on which all paths of the key agree, up to the first on which they do not: no path list is gathered."""
    sizes = rows.groupBy(*key).agg(F.min(F.size(path)).alias("_least"))
    levels = rows.select(*key, F.posexplode(path).alias("_at", "_label"))
    agreed = levels.groupBy(*key, "_at").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"))
    agreed = agreed.join(sizes, key).where("_at < _least")
    first_bad = agreed.where("_lo <> _hi").groupBy(*key).agg(F.min("_at").alias("_bad"))
    good = agreed.join(first_bad, key, "left").where(F.col("_bad").isNull() | (F.col("_at") < F.col("_bad")))
    listed = good.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_lo"))), lambda x: x["_lo"]).alias("prefix"))
    return sizes.select(*key).join(listed, key, "left").withColumn("prefix", F.coalesce("prefix", F.array().cast("array<string>")))


def round_robin(rows: DataFrame, group: list[str], order: list[Column], budget: int) -> DataFrame:
    """``budget`` rows, taken in turn from each group: first all firsts, then all seconds, groups by name."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("turn", F.row_number().over(window))
    return ranked.orderBy("turn", *group).limit(budget)


def diversify(rows: DataFrame, book: str, score: str, key: str, limit: int) -> DataFrame:
    """The best row of every book first, then the rest by score, up to ``limit``, with its final ``place``."""
    window = Window.partitionBy(book).orderBy(F.desc(score), key)
    ranked = rows.withColumn("_first", F.row_number().over(window) == 1)
    top = ranked.orderBy(F.desc("_first"), F.desc(score), key).limit(limit)
    # at most ``limit`` rows
    place = Window.orderBy(F.desc("_first"), F.desc(score), F.col(key))
    return top.withColumn("place", F.row_number().over(place)).drop("_first")


def stated(rows: DataFrame, queries: DataFrame, condition: Column, block: int = 5_000) -> DataFrame:
    """Rows and queries of a stated set that meet ``condition``, where the rows lie.

    The queries are counted, cut into blocks of about ``block`` by hash, and each
    block is broadcast; a set of any size works, with one pass over the rows for
    each block."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == k)
        found = rows.join(F.broadcast(part), condition)
        out = found if out is None else out.unionByName(found)
    return out
