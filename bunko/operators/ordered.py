"""Joins and windows over ordered rows: as-of and range joins, gap clusters, islands, breaker states, history pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row (key, at, ...) with the values of the last right row (key, at, values) not after it. Both sides are
    sorted once, together; of right rows at one time the one that comes last by its values counts."""
    last = F.struct(*values)
    none = F.lit(None).cast(right.select(last.alias("x")).schema[0].dataType)
    rows = left.withColumn("_v", none).withColumn("_side", F.lit(1))
    marks = right.groupBy(key, at).agg(F.max(last).alias("_v")).withColumn("_side", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_v", seen).where("_side = 1").select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: float, order: list[str] | None = None) -> DataFrame:
    """Points (key, at, ...) with the spans (key, start, end, ...) that hold them, ends included. Spans are cut into cells
    of a width and meet points by key and cell. With an order of spans, only the first one of each point (id) is kept."""
    cell = lambda c: F.floor(c / width)
    held = spans.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    met = points.withColumn("_cell", cell(F.col(at))).join(held, [key, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")
    if not order:
        return met
    ids = [c for c in points.columns]
    rest = [c for c in spans.columns if c != key]
    first = met.groupBy(*ids).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_s"))
    return first.select(*ids, *(F.col(f"_s.{c}").alias(c) for c in rest))


def gap_clusters(rows: DataFrame, key: str, at: str, factor: float) -> DataFrame:
    """(key, cluster, first, last, n): values of each key split where the gap to the one before exceeds a tolerance. It is
    the median gap times the factor if the largest gap is at least twice the median, else 0.9 of the tenth-lowest gap;
    at least 1 and rounded down. Quantiles are elements, at a rank rounded down, by windows and not by collecting."""
    values = rows.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(at)
    gaps = values.withColumn("gap", F.col(at) - F.lag(at).over(order))
    by_gap = Window.partitionBy(key).orderBy(F.col("gap").asc_nulls_last(), at)
    ranked = gaps.withColumn("rank", F.row_number().over(by_gap) - 1).withColumn("m", F.count("gap").over(Window.partitionBy(key)))
    at_rank = lambda q: F.max(F.when(F.col("rank") == F.floor((F.col("m") - 1) * q), F.col("gap")))
    limit = ranked.groupBy(key).agg(at_rank(0.5).alias("p50"), at_rank(0.1).alias("p10"), F.max("gap").alias("most"))
    wide = (F.col("p50") > 0) & (F.col("most") >= 2 * F.col("p50"))
    limit = limit.select(key, F.greatest(F.lit(1), F.floor(F.when(wide, F.col("p50") * factor).otherwise(F.col("p10") * 0.9))).alias("tolerance"))
    head = F.coalesce(F.col("gap") > F.col("tolerance"), F.lit(False)).cast("int")
    placed = gaps.join(limit, key).withColumn("cluster", F.sum(head).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(key, "cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.sum("n").alias("n"))


def runs(rows: DataFrame, keys: list[str], at: str, style: Column) -> DataFrame:
    """(keys, style, first, last, n): neighbours of equal style merged; null is a style."""
    order = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("style", style)
    new = F.when((F.row_number().over(order) > 1) & F.col("style").eqNullSafe(F.lag("style").over(order)), 0).otherwise(1)
    return marked.withColumn("_run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run", "style").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def inherit(rows: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """A missing value taken from the neighbours before and after that have one, where these agree."""
    order = Window.partitionBy(*keys).orderBy(*at)
    before = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(F.col(value), F.when(before == after, before)))


def breaker(rows: DataFrame, key: str, at: str, order: list[str], failed: Column, limit: int, seconds: float) -> DataFrame:
    """Calls (key, at, order) with `broken`: is the breaker open when the call comes? `limit` failures in a row open it for
    some seconds; a success sets the count back."""
    before = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_f", F.coalesce(failed, F.lit(False)))
    island = F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_i", island)
    streak = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(key, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("streak", streak)
    opened = F.last(F.when(F.col("streak") >= limit, F.col(at)), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("broken", F.coalesce(F.col(at) - opened < seconds, F.lit(False))).drop("_f", "_i")


def within_budget(rows: DataFrame, keys: list[str], order: str, size: str, budget: int, most: int) -> DataFrame:
    """(keys, order, size, accepted): rows are accepted in their order while they fit the key's budget; one that is larger
    than `most` or than what is left is skipped, and smaller ones after it may still fit. A null size never fits. What
    can't fit at all isn't sorted; the rest passes the fold batch by batch, with one number kept for each key."""
    rows = rows.select(*keys, order, F.col(size).cast("bigint").alias(size))
    small = F.coalesce(F.col(size).between(0, min(budget, most)), F.lit(False))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, 0
        for batch in batches:
            taken = []
            for *at, n in zip(*(batch[k] for k in keys), batch[size]):
                at = [None if pd.isna(k) else k for k in at]
                if at != key:
                    key, used = at, 0
                taken.append(used + n <= budget)
                used += n if taken[-1] else 0
            yield batch.assign(accepted=taken)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"
    placed = rows.where(small).repartition(*keys).sortWithinPartitions(*keys, order)
    return placed.mapInPandas(fold, schema).unionByName(rows.where(~small).withColumn("accepted", F.lit(False)))


def pruned_history(rows: DataFrame, keys: list[str], order: str, size: str, budget: int, head: int, tail: int, shown: int) -> DataFrame:
    """Messages with the part of them that is kept: all of a history within the budget or no longer than head and tail;
    else the first and last ones whole and those between cut."""
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    whole = Window.partitionBy(*keys)
    long = (F.sum(size).over(whole) > budget) & (F.count("*").over(whole) > head + tail)
    between = (F.row_number().over(up) > head) & (F.row_number().over(down) > tail)
    return rows.withColumn("kept", F.when(long & between, F.least(F.col(size), F.lit(shown))).otherwise(F.col(size)))
