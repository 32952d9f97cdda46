"""Incremental and stateful operators on event streams; each works on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, at: str = "ts") -> DataFrame:
    """The time column with a zone, which watermarks need."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def usage(df: DataFrame, by: str, value: str) -> DataFrame:
    """Running totals: in update mode a changed group comes again."""
    return df.groupBy(by).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))


def tumbling(df: DataFrame, at: str, size: str, by: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of windows; ``late`` is how long a window waits for late rows."""
    rows = timed(df, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    rows = timed(df, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def _allow(times: list[float], recent: list[float], short: tuple[float, int], long: tuple[float, int]) -> tuple[list[bool], list[float]]:
    out = []
    for t in times:
        recent = [x for x in recent if x > t - long[0]]
        ok = sum(x > t - short[0] for x in recent) < short[1] and len(recent) < long[1]
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


def rate_limit(
    df: DataFrame, by: str, at: str, key: str, short: tuple[float, int] = (1.0, 5), long: tuple[float, int] = (60.0, 100), late: str = "1 hour",
) -> DataFrame:
    """(by, key, allowed): a hit passes if few passed in the last short and long spans; denied hits don't count.

    The decision of a hit depends on those before it, so each key is folded in
    time order.  On a stream the state of a key is at most ``long[1]`` times,
    and is dropped when the watermark (``late`` behind the last hit) has passed
    its last hit by the long span.  In a batch a key is cut
    wherever no hit stands within the long span before, since what follows
    doesn't depend on what was: a busy key's stretches are folded apart, each
    sorted and read batch by batch.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{by}` {kind[by]}, `{key}` {kind[key]}, allowed boolean"
    rows = df.select(by, key, F.unix_micros(F.col(at).cast("timestamp")).alias("__us"))
    if df.isStreaming:
        rows = df.select(by, key, F.col(at).cast("timestamp").alias("__at")).withWatermark("__at", late).withColumn("__us", F.unix_micros("__at"))

        def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            recent = list(state.get[0]) if state.exists else []
            pdf = pd.concat(list(frames)).sort_values(["__us", key])
            ok, recent = _allow((pdf["__us"] / 1e6).tolist(), recent, short, long)
            state.update((recent,))
            state.setTimeoutTimestamp(max(int(pdf["__us"].max() // 1000 + long[0] * 1000), state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({by: pdf[by], key: pdf[key], "allowed": ok})

        return rows.groupBy(by).applyInPandasWithState(step, schema, "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for pdf in frames:
            allowed = []
            for who, part in pdf.groupby([by, "__part"], sort=False, dropna=False):
                if who != last:
                    last, recent = who, []
                ok, recent = _allow((part["__us"] / 1e6).tolist(), recent, short, long)
                allowed += ok
            yield pd.DataFrame({by: pdf[by], key: pdf[key], "allowed": allowed})

    # slots of the long span that hold a hit; a slot after an empty one starts a stretch of its own
    slot = F.floor(F.col("__us") / F.lit(int(long[0] * 1e6)))
    rows = rows.withColumn("__slot", slot)
    w = Window.partitionBy("__by").orderBy("__s")
    slots = rows.select(F.col(by).alias("__by"), F.col("__slot").alias("__s")).distinct()
    slots = slots.withColumn("__part", F.sum(F.when(F.col("__s") - F.lag("__s").over(w) <= 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.join(slots, rows[by].eqNullSafe(F.col("__by")) & F.col("__slot").eqNullSafe(F.col("__s"))).select(by, key, "__us", "__part")
    return own.repartition(by, "__part").sortWithinPartitions(by, "__part", "__us", key).mapInPandas(fold, schema)


def incremental(spark: SparkSession, source: str, schema, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Handle the files that are new since the last call, once each; the checkpoint remembers which were seen."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_into(path: str, key: str, order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A handler that upserts each batch into a keyed table: only touched buckets are rewritten, a failed batch leaves the last commit."""
    from ..operators.joins import upsert
    from ..sources.tables import KeyedTable

    def handle(batch: DataFrame, number: int) -> None:
        changes = upsert(batch.limit(0), batch, key, order)
        KeyedTable(batch.sparkSession, path, key, buckets).merge(changes, lambda base, new: new if base is None else upsert(base, new, key, order))

    return handle


def audit_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)
