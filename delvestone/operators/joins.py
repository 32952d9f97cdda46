"""Joins that aren't a plain equality: diffs, ranges, as-of, co-occurrence, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_set(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified, deleted or unchanged between two snapshots."""
    a = before.select(key, F.col(digest).alias("__a"), F.lit(True).alias("__was"))
    b = after.select(key, F.col(digest).alias("__b"), F.lit(True).alias("__is"))
    change = (
        F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "deleted")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("modified")
    )
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, of each key the one of the highest ``order``; ties go to the change."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.desc("__new")))
    return both.withColumn("__r", r).where("__r = 1").drop("__r", "__new")


def co_occurrence(pairs: DataFrame, item: str, group: str, step: float = 0.25, most: int = 2000, least: int = 1) -> DataFrame:
    """(a, b, shared, weight) of items that share groups; weight = min(1, step * shared).

    A group's items are joined on the group.  A group of over ``most`` items
    is cut into blocks, and its pairs of blocks are spread over tasks, so that
    a hot group is never one task's work; no pair is lost.
    """
    own = pairs.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    size = own.groupBy("g").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks"))
    cut = own.join(size, "g").withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    # a row goes to each pair of blocks that its block is the first, or the second, of
    left = cut.select("g", F.col("i").alias("a"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    right = cut.select("g", F.col("i").alias("b"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    return (
        left.join(right, ["g", "x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
        .withColumn("weight", F.least(F.lit(1.0), F.col("shared") * F.lit(step)))
    )


def as_of(rows: DataFrame, points: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each row the value of the last point at or before it, by union and a running last value."""
    left = rows.withColumn("__v", F.lit(None).cast(points.schema[value].dataType)).withColumn("__row", F.lit(1))
    right = points.select(by, at, F.col(value).alias("__v")).withColumn("__row", F.lit(0))
    w = Window.partitionBy(by).orderBy(at, "__row").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__row = 1").drop("__row").withColumnRenamed("__v", value)


def range_join(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points in spans [start, end): equality on the key and on a bucket of ``width``, then the exact test."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, [by, "__bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")
