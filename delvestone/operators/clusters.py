"""Knowledge clusters: updates, merging, edges, expansion over the graph, tiers of reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import upsert


def insert_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Base rows and those rows whose key isn't there yet."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti"))


def update(base: DataFrame, changes: DataFrame, key: str, columns: list[str], now) -> DataFrame:
    """Columns taken from the change where it has a value; version and time of the changed rows move on."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns], F.lit(True).alias("__hit"))
    out = base.join(c, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    new = {x: F.coalesce(f"__{x}", x) for x in columns}
    new["version"] = F.when(hit, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version"))
    new["last_modified"] = F.when(hit, now).otherwise(F.col("last_modified"))
    return out.withColumns(new).select(*base.columns)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def merge_edges(edges: DataFrame, source: str, target: str, kind: str, weight: str) -> DataFrame:
    """One edge of each source, target and kind, of the highest weight."""
    return edges.groupBy(source, target, kind).agg(F.max(weight).alias(weight))


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges in both directions."""
    return edges.unionByName(edges.withColumns({"__t": F.col(a)}).withColumn(a, F.col(b)).withColumn(b, F.col("__t")).drop("__t"))


def expand(seeds: DataFrame, edges: DataFrame, key: str, k: int = 6) -> DataFrame:
    """The k neighbours of greatest weight of the seed rows, without the seeds."""
    near = edges.withColumnRenamed("a", key).join(seeds.select(key), key, "left_semi")
    best = near.groupBy("b").agg(F.max("weight").alias("weight")).withColumnRenamed("b", "__n")
    out = best.join(seeds.select(F.col(key).alias("__n")), "__n", "left_anti").withColumnRenamed("__n", key)
    return out.orderBy(F.desc("weight"), key).limit(k)


def tier(similarity: str, hard: float = 0.8, soft: float = 0.5):
    return F.when(F.col(similarity) >= hard, "merge").when(F.col(similarity) >= soft, "link").otherwise("new")


def promoted(lifecycle: str = "lifecycle", merges: str = "merge_count", least: int = 3):
    """The lifecycle in one case; an emerging cluster merged often enough is stable."""
    u = F.upper(lifecycle)
    return F.when((u == "EMERGING") & (F.coalesce(merges, F.lit(0)) >= least), "STABLE").otherwise(u)


def hotter(hotness: str = "hotness", step: float = 0.1):
    return F.round(F.least(F.lit(1.0), F.coalesce(hotness, F.lit(0.5)) + F.lit(step)), 6)


def primary_files(evidences: str = "evidences"):
    """The distinct files of a cluster's evidence (JSON), sorted; null where the JSON is broken or missing."""
    own = F.from_json(F.col(evidences), "array<struct<doc_id:string>>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda x: x["doc_id"]), lambda x: x.isNotNull())))


def conflict_groups(df: DataFrame, key: str, files: str) -> DataFrame:
    """(file, members): the files that several clusters rest on, with how many do."""
    each = df.select(key, F.explode(files).alias("file")).distinct()
    return each.groupBy("file").agg(F.count("*").alias("members")).where("members > 1")


__all__ = ["conflict_groups", "primary_files", "delete", "expand", "hotter", "insert_new", "merge_edges", "promoted", "tier", "undirected", "update", "upsert"]
