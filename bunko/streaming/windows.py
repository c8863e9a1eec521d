"""Windowed aggregates over events, in batch and as Structured Streaming with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bunko.session import scratch, table


def _totals(df: DataFrame, window, *keys: str) -> DataFrame:
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _totals(events, F.window("ts", size), "event_type").select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _totals(events, F.window("ts", size, step), "event_type").select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return _totals(events, F.session_window("ts", gap), "user_id").select("user_id", F.col("w.start").alias("session_start"), "n", "total")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a table may be one file or a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def finish(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and give its result: in the shared folder, with its checkpoint beside it."""
    spark, base = stream.sparkSession, scratch(stream.sparkSession, "stream")
    schema = stream.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    done = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    return done


def streamed_tumbling(spark: SparkSession, sf_dir: str, name: str, size: str, late: str = "2 days") -> DataFrame:
    events = read_stream(spark, sf_dir, name).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # updates of one window may come in several batches; the last, with the largest count, holds
    updates = finish(tumbling(events, size), "update")
    return updates.groupBy("window_start", "event_type").agg(F.max(F.struct("n", "total")).alias("x")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "x.n", "x.total")


def streamed_unique(spark: SparkSession, sf_dir: str, name: str, key: list[str], late: str = "2 days") -> DataFrame:
    rows = read_stream(spark, sf_dir, name)
    ts = rows.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", late)
    return finish(ts.dropDuplicatesWithinWatermark(key).select(*key, "type"), "append").groupBy("type").agg(F.count("*").alias("n"))


def slices(rows: DataFrame, at: str, n: int) -> DataFrame:
    """Rows with a `slice` from 0 to n - 1: equal spans of time from the first to the last."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    ends = rows.agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    place = F.floor((micros - F.col("_lo")) * n / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    return rows.crossJoin(F.broadcast(ends)).withColumn("slice", F.least(place, F.lit(n - 1))).drop("_lo", "_hi")


def replayed(rows: DataFrame, n: int, query, mode: str) -> DataFrame:
    """A stream over rows that come slice by slice: each slice's files are added to a folder and the query, with its
    checkpoint, takes up what is new. The result of every batch, with its number."""
    spark = rows.sparkSession
    source, base = scratch(spark, "source"), scratch(spark, "stream")
    kept = rows.drop("slice")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch_{epoch}")

    for k in range(n):
        rows.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(source)
        stream = query(spark.readStream.schema(kept.schema).parquet(source))
        schema = stream.schema
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", batch int").parquet(f"{base}/out/*")


def replayed_tumbling(events: DataFrame, at: str, key: str, arrived: str, n: int, size: str, late: str) -> DataFrame:
    """(window_start, key, n) of events that come in n slices by their arrival. An event is dropped if its window had
    ended, by more than `late` before the latest event of earlier slices, when it came; its window's state is gone then."""
    counted = lambda s: s.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
    rows = slices(events.withColumn("ts", F.col(at).cast("timestamp")), arrived, n).select("ts", key, "slice")
    updates = replayed(rows, n, counted, "update")
    return updates.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), key).agg(F.max("n").alias("n"))


def replayed_breaker(calls: DataFrame, n: int, limit: int, seconds: float) -> DataFrame:
    """(id, streak, broken) of calls (key, id, at, failed) that come in n slices of time: `limit` failures in a row open a
    key's breaker for some seconds, a success sets the count back. The state of a key, kept from batch to batch, is its
    count and the time when the breaker was opened last; within a batch calls are taken by time and id."""

    def judged(key: tuple, parts, state: GroupState):
        streak, opened = state.get if state.exists else (0, None)
        batch = pd.concat(list(parts)).sort_values(["at", "id"], kind="stable")
        out = []
        for i, at, failed in zip(batch["id"], batch["at"], batch["failed"]):
            broken = opened is not None and at - opened < seconds
            streak = streak + 1 if failed else 0
            if streak >= limit:
                opened = float(at)
            out.append((i, streak, broken))
        state.update((streak, opened))
        yield pd.DataFrame(out, columns=["id", "streak", "broken"])

    def query(stream: DataFrame) -> DataFrame:
        return stream.groupBy("key").applyInPandasWithState(judged, "id bigint, streak bigint, broken boolean", "streak bigint, opened double", "append", GroupStateTimeout.NoTimeout)

    rows = calls.select("key", F.col("id").cast("bigint").alias("id"), F.col("at").cast("double").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return replayed(slices(rows.where("key IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL").withColumn("_at", F.timestamp_seconds("at")), "_at", n).drop("_at"), n, query, "append").drop("batch")
