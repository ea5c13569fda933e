"""Graph reads: trusted edges, contexts, expansion, groups, boards, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ilike_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of at most three terms, case aside; % and _ in a term stand for themselves."""
    low = F.lower(T.text(text))
    out = F.lit(False)
    for term in [t for t in terms if t][:3]:
        out = out | low.contains(term.lower())
    return out


def trusted(review: Column, structural: Column, verified: Column) -> Column:
    """Approved by a reviewer, or structural and verified by rule."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(review == "approved") | (yes(structural) & yes(verified))


def concept_groups(rows: DataFrame, book: str, concept: str, order: list[str], item: str) -> DataFrame:
    """book, concept, place (by first sight), n, items in order."""
    key = F.struct(*order)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(item).alias("item")))), lambda x: x["item"])
    g = rows.groupBy(book, concept).agg(F.min(key).alias("_first"), F.count("*").alias("n"), listed.alias("items"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy("_first"))).drop("_first")


def node_context(nodes: DataFrame, both_ways: DataFrame, key: str, name: str, limit: int = 30) -> DataFrame:
    """node, n, context: names of at most ``limit`` neighbours of each node, by name and id, in one line.

    ``both_ways`` (node, other) comes from ``relational.neighbours``; the rank is cut before names are gathered."""
    named = both_ways.distinct().join(nodes.select(F.col(key).alias("other"), F.col(name).alias("_name")), "other")
    window = Window.partitionBy("node").orderBy("_name", "other")
    top = named.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_name"))), lambda x: x["_name"])
    return top.groupBy("node").agg(F.count("*").alias("n"), F.array_join(listed, "; ").alias("context"))


def expand(seeds: DataFrame, groups: DataFrame, edges: DataFrame, key: str, group: str, source: str, target: str) -> DataFrame:
    """node, via: seeds, members of their groups, and what edges lead to from any of these; the nearest way wins."""
    s = seeds.select(F.col(key).alias("node")).distinct()
    members = groups.select(F.col(key).alias("node"), F.col(group).alias("_g"))
    near = members.join(members.join(s, "node", "left_semi").select("_g").distinct(), "_g", "left_semi").select("node")
    base = s.withColumn("_d", F.lit(0)).unionByName(near.withColumn("_d", F.lit(1))).groupBy("node").agg(F.min("_d").alias("_d"))
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("to")).unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("to")))
    reached = e.join(base.select("node"), "node", "left_semi").select(F.col("to").alias("node"), F.lit(2).alias("_d"))
    all_ = base.unionByName(reached).groupBy("node").agg(F.min("_d").alias("_d"))
    return all_.select("node", F.when(F.col("_d") == 0, "seed").when(F.col("_d") == 1, "group").otherwise("edge").alias("via"))


def gather(rows: DataFrame, key: list[str], order: str, size: str, most_rows: int = 4, most_size: int = 4000) -> DataFrame:
    """The first rows of each key while there are at most ``most_rows`` and what came before is under ``most_size``."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"_k": F.row_number().over(w), "_b": before}).where((F.col("_k") <= most_rows) & (F.col("_b") < most_size)).drop("_k", "_b")


def merge_decisions(nodes: DataFrame, key: str, book: str, name: str, score: str, least: float) -> DataFrame:
    """key, decision: merge where a node of another book has the same normalised name, else keep from ``least`` on, else drop.

    Counts of books by name decide, so no pair is formed."""
    n = nodes.withColumn("_n", T.normalize_name(name))
    books = n.where("_n <> ''").groupBy("_n").agg(F.countDistinct(book).alias("_books"))
    j = n.join(books, "_n", "left")
    return j.select(key, F.when(F.col("_books") > 1, "merge").when(F.col(score) >= least, "keep").otherwise("drop").alias("decision"))


def integrated(rows: DataFrame, key: list[str], order: list[Column], text: str, most: int = 2) -> DataFrame:
    """key, n_sources, chars_before, chars_after, text: the first ``most`` distinct texts of a key joined."""
    w = Window.partitionBy(*key).orderBy(*order)
    one = rows.withColumn("_seen", F.row_number().over(Window.partitionBy(*key, text).orderBy(*order)))
    one = one.withColumn("_k", F.when(F.col("_seen") == 1, F.sum((F.col("_seen") == 1).cast("int")).over(w)))
    kept = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col(text).alias("t")))))
    joined = F.array_join(F.transform(kept, lambda x: x["t"]), "\n")
    return one.groupBy(*key).agg(F.count("*").alias("n_sources"), F.sum(F.length(text)).alias("chars_before"), F.length(joined).cast("long").alias("chars_after"), joined.alias("text"))


def visible(nodes: DataFrame, both_ways: DataFrame, anchor: Column, key: str, book: str, score: str, budget: int) -> DataFrame:
    """key, reason of the shown nodes: the anchors, all next to them, the best of every other book, then by score up to ``budget``."""
    a = nodes.where(anchor).select(F.col(key).alias("node"))
    near = both_ways.join(a, "node", "left_semi").select(F.col("other").alias("_near")).distinct()
    j = nodes.join(near, F.col(key) == F.col("_near"), "left")
    best = F.row_number().over(Window.partitionBy(book).orderBy(F.desc(score), key)) == 1
    rank = F.when(anchor, 0).when(F.col("_near").isNotNull(), 1).when(best, 2).otherwise(3)
    got = j.withColumn("_r", rank)
    shown = got.where("_r < 3").select(key, "_r")
    # the rest fills up what is left of the budget
    rest = got.where("_r = 3").orderBy(F.desc(score), key).limit(budget).select(key, "_r", score)
    left = shown.agg(F.greatest(F.lit(budget) - F.count("*"), F.lit(0)).alias("_left"))
    w = Window.orderBy(F.desc(score), key)
    rest = rest.withColumn("_k", F.row_number().over(w)).crossJoin(F.broadcast(left)).where("_k <= _left").select(key, "_r")
    name = F.when(F.col("_r") == 0, "anchor").when(F.col("_r") == 1, "neighbour").when(F.col("_r") == 2, "book").otherwise("score")
    return shown.unionByName(rest).select(key, name.alias("reason"))


def board_violations(links: DataFrame, cards: DataFrame, key: str, source: str, target: str, card: str) -> DataFrame:
    """key, violation: links to missing cards, to themselves, or that repeat an earlier link either way round."""
    c = cards.select(F.col(card).alias("_c")).distinct()
    missing = links.join(c, F.col(source) == F.col("_c"), "left_anti").unionByName(links.join(c, F.col(target) == F.col("_c"), "left_anti")).select(key, F.lit("missing_card").alias("violation")).distinct()
    own = links.where(F.col(source) == F.col(target)).select(key, F.lit("self_link").alias("violation"))
    w = Window.partitionBy(F.least(source, target), F.greatest(source, target)).orderBy(key)
    again = links.withColumn("_k", F.row_number().over(w)).where("_k > 1").select(key, F.lit("repeated").alias("violation"))
    return missing.unionByName(own).unionByName(again)


def tree_findings(rows: DataFrame, key: str, parent: str, level: str, order: str, start: str, stop: str) -> DataFrame:
    """key, finding: parents that are missing, levels that do not follow their parent's, orders used twice, ranges outside the parent's."""
    up = rows.select(F.col(key).alias("_p"), F.col(level).alias("_lv"), F.col(start).alias("_s"), F.col(stop).alias("_e"))
    j = rows.join(up, F.col(parent) == F.col("_p"), "left").withColumn("_same", F.count("*").over(Window.partitionBy(order)))
    has = F.col(parent).isNotNull()
    rules = {
        "missing_parent": has & F.col("_p").isNull(),
        "level": F.col("_p").isNotNull() & (F.col(level) != F.col("_lv") + 1),
        "order": F.col("_same") > 1,
        "range": (F.col(start) > F.col(stop)) | (F.col("_p").isNotNull() & ((F.col(start) < F.col("_s")) | (F.col(stop) > F.col("_e")))),
    }
    hits = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return j.select(key, F.explode(hits).alias("finding"))


def parent_of(rows: DataFrame, group: list[str], order: str, level: str, key: str) -> DataFrame:
    """Adds parent: the last row before that has a smaller level, null at the top.

    The levels there are (a few numbers) are read first; one pass in order then
    keeps the last row of each."""
    levels = sorted(r[0] for r in rows.select(level).distinct().collect() if r[0] is not None)
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    lasts = {f"_l{i}": F.last(F.when(F.col(level) == k, here), ignorenulls=True).over(w) for i, k in enumerate(levels)}
    out = rows.withColumns(lasts) if lasts else rows
    below = [F.when(F.col(level) > k, F.col(f"_l{i}")) for i, k in enumerate(levels)]
    none = F.lit(None).cast(rows.schema[key].dataType)
    best = F.greatest(*below, *below[:1])["k"] if below else none
    return out.withColumn("parent", best).drop(*lasts)


def merged_batches(current: DataFrame, deltas: DataFrame, batch: str, key: str, foreign: Column, most: int) -> DataFrame:
    """key, accepted_from: keys after merging batches; a batch with a foreign row or over ``most`` rows is rejected whole, repeats change nothing."""
    ok = deltas.groupBy(batch).agg((~F.bool_or(F.coalesce(foreign, F.lit(True))) & (F.count("*") <= most)).alias("_ok")).where("_ok").select(batch)
    new = deltas.join(ok, batch, "left_semi").groupBy(key).agg(F.min(F.col(batch).cast("string")).alias("accepted_from"))
    old = current.select(key, F.lit("current").alias("accepted_from"))
    return old.unionByName(new.join(old.select(F.col(key).alias("_o")), F.col(key) == F.col("_o"), "left_anti"))


def removed_selection(cards: DataFrame, links: DataFrame, gone: DataFrame, card: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Cards and links that are left when the ``gone`` cards go, links that touch them included."""
    g = gone.select(F.col(card).alias("_g"))
    left = links.join(g, F.col(source) == F.col("_g"), "left_anti").join(g, F.col(target) == F.col("_g"), "left_anti")
    return cards.join(g, F.col(card) == F.col("_g"), "left_anti"), left


def exact_scope_runs(runs: DataFrame, members: DataFrame, run: str, member: str, scope: list, newest: str) -> DataFrame:
    """The newest run whose members are exactly ``scope``, as one row, or none."""
    sets = members.groupBy(run).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    want = F.array_sort(F.array(*map(F.lit, sorted(set(scope)))))
    return runs.join(sets.where(F.col("_set") == want).select(run), run, "left_semi").orderBy(F.desc(newest), run).limit(1)
