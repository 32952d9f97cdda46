"""Sequence operators on ordered rows: pruning, context windows, budgets, runs, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(by: list[str]) -> Window:
    return Window.partitionBy(*by)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, total: bool = False) -> DataFrame:
    """The first ``k`` of each group; with ``total`` also the group's size before.

    The rank alone lets Spark keep k rows of each group on the map side, so
    that a hot group is never in one task; the sizes are therefore counted
    apart, with partial sums, and joined to the few rows that are left.
    """
    out = df.withColumn("rank", F.row_number().over(_by(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)
    if not total:
        return out
    size = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count("*").alias("total"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return out.join(size, same).drop(*[f"__{c}" for c in by])


def gap_prune(df: DataFrame, by: list[str], score: str, key: str, floor: float = 0.3, gap: float = 0.5, least: int = 1, most: int = 10) -> DataFrame:
    """Rows of at least ``floor`` of the best score, cut at the first drop of more than ``gap``; at least ``least``, at most ``most``."""
    w = _by(by).orderBy(F.col(score).desc(), key)
    cut = F.col(score) < F.lag(score).over(w) * (1 - gap)
    out = df.withColumns({"rank": F.row_number().over(w).cast("bigint"), "__max": F.max(score).over(_by(by)), "__cut": F.coalesce(cut, F.lit(False)).cast("int")})
    out = out.withColumn("__cuts", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = ((F.col(score) >= F.col("__max") * floor) & (F.col("__cuts") == 0)) | (F.col("rank") <= least)
    return out.where(keep & (F.col("rank") <= most)).drop("__max", "__cut", "__cuts")


def merge_windows(hits: DataFrame, by: list[str], at: str, reach: int) -> DataFrame:
    """Intervals of ``reach`` around each hit, overlapping and adjacent ones merged, with the number of hits."""
    w = _by(by).orderBy(at)
    spans = hits.withColumns({"start": F.greatest(F.lit(1), F.col(at) - reach), "end": F.col(at) + reach})
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("hits")).drop("island")


def budget(df: DataFrame, by: list[str], order: list, size: str, limit: int) -> DataFrame:
    """Rows in order while their sizes fit; ``kept`` is the size, that of the last row what is left of the budget."""
    w = _by(by).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(F.col("__before") < limit).withColumn("kept", F.least(F.col(size), F.lit(limit) - F.col("__before"))).drop("__before")


def next_value(df: DataFrame, by: list[str], order: str, column: str, name: str, default=None) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.lead(column).over(_by(by).orderBy(order)), default if default is not None else F.lit(None)))


def parents(df: DataFrame, by: list[str], index: str, level: str) -> DataFrame:
    """The nearest row before of a lower level: a running last index for each level, and the greatest of those below.

    No self-join: one pass over each group's order.  As many levels are
    followed as the data have (their distinct values, one small row).
    """
    w = _by(by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(df.where(F.col(level).isNotNull()).agg(F.collect_set(level)).first()[0])
    last = {f"__l{i}": F.max(F.when(F.col(level) == n, F.col(index))).over(w) for i, n in enumerate(levels)}
    near = [F.when(F.col(level) > n, F.col(f"__l{i}")) for i, n in enumerate(levels)]
    none = F.lit(None).cast("bigint")
    return df.withColumns(last).withColumn("parent", F.greatest(none, none, *near)).drop(*last)


def runs(df: DataFrame, by: list[str], order: str, holds, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive rows for which a predicate holds: first, last and length."""
    w = _by(by).orderBy(order)
    n = df.withColumns({"__ok": holds.cast("int"), "__n": F.row_number().over(w)})
    n = n.where("__ok = 1").withColumn("__g", F.col("__n") - F.row_number().over(w))
    return n.groupBy(*by, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__g")


def round_robin(df: DataFrame, group: str, within: list, k: int, by: list[str]) -> DataFrame:
    """The best of each group, then the second of each, and so on: the first ``k`` of that order."""
    deal = F.row_number().over(Window.partitionBy(*by, group).orderBy(*within))
    return top_per_group(df.withColumn("deal", deal.cast("bigint")), by, [F.col("deal"), F.col(group)], k)
