"""Checks and decisions around what is delivered: commands, error classes, claims, client groups, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def decision(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first case that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def command(text: Column, words: dict[str, list[str]], otherwise: str = "explain") -> Column:
    """What a message asks for: the first command one of whose words is in it."""
    low = F.lower(T.text(text))
    return decision([(F.greatest(*(low.contains(w).cast("int") for w in ws), F.lit(0)) == 1, name) for name, ws in words.items()], otherwise)


def error_class(status: Column, message: Column) -> Column:
    low = F.lower(T.text(message))
    return decision([
        (F.coalesce(status == 402, F.lit(False)), "quota"),
        (F.coalesce(status.isin(401, 403), F.lit(False)), "credentials"),
        (low.rlike("timed? ?out"), "timeout"),
        (low.contains("connect"), "connection"),
        (F.coalesce(status.between(400, 404), F.lit(False)), "request"),
        (F.trim(low) == "", "empty"),
    ], "other")


def findings(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules.items())))


def claim_checks(rows: DataFrame, claim: str, book: str, citation: str, minutes: str) -> DataFrame:
    """For each claim: minutes, n_books, shared (two books and more), grounded (no citation is missing)."""
    return rows.groupBy(claim).agg(
        F.sum(minutes).cast("long").alias("minutes"),
        F.countDistinct(book).alias("n_books"),
        (F.countDistinct(book) >= 2).alias("shared"),
        F.bool_and(F.col(citation).isNotNull()).alias("grounded"),
    )


def group_edges(edges: DataFrame, members: DataFrame, source: str, target: str, key: str, group: str) -> DataFrame:
    """group_a, group_b, n: edges between groups of nodes; edges inside one group or to no group are left out."""
    side = lambda end, name: members.select(F.col(key).alias(end), F.col(group).alias(name))
    j = edges.join(side(source, "_a"), source).join(side(target, "_b"), target).where("_a <> _b")
    return j.groupBy(F.least("_a", "_b").alias("group_a"), F.greatest("_a", "_b").alias("group_b")).agg(F.count("*").alias("n"))


def water_level(rows: DataFrame, group: list[str], key: str, size: str, share: float) -> DataFrame:
    """group, level: the cut that brings each group's sizes down to ``share`` of their sum; null where nothing is cut.

    Over sizes in order, a size stays whole while all larger ones cut to it still
    fit; what is then left is shared by the others."""
    w = Window.partitionBy(*group)
    up = w.orderBy(size, key).rowsBetween(Window.unboundedPreceding, 0)
    s = rows.withColumns({"_run": F.sum(size).over(up), "_above": F.count("*").over(w) - F.row_number().over(w.orderBy(size, key)), "_budget": F.sum(size).over(w) * F.lit(share)})
    whole = F.col("_run") + F.col("_above") * F.col(size) <= F.col("_budget")
    g = s.groupBy(*group).agg(F.max("_budget").alias("_budget"), F.coalesce(F.sum(F.when(whole, F.col(size))), F.lit(0)).alias("_filled"), F.count_if(~whole).alias("_open"))
    return g.select(*group, F.when(F.col("_open") > 0, F.floor((F.col("_budget") - F.col("_filled")) / F.col("_open"))).alias("level"))
