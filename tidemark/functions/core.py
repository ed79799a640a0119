"""Small building blocks. Times are whole numbers inside: event times in milliseconds, others in seconds or minutes since 1970 (UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moment(seconds: Column) -> Column:
    """Seconds since 1970 as a time without zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def moment_ms(ms: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / F.lit(1000)).cast("decimal(18,6)"))


def div(x: Column, by: int) -> Column:
    """Whole part of a division, rounded down."""
    return F.floor(x / F.lit(by)).cast("long")


def hundredths(of: Column, by: Column) -> Column:
    """Hundredths of a quotient of whole numbers, rounded half up; in whole numbers, so that no order of summing moves a tie."""
    return F.floor((F.lit(200) * of + by) / (F.lit(2) * by)).cast("long")


def quantile_exact(x: Column, p: float) -> Column:
    """The order statistic at index floor(p n), counted from 0; an aggregate. Its group must be of a bounded kind."""
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, (F.least(F.floor(F.lit(p) * F.size(values)), F.size(values) - 1) + 1).cast("int"))


def with_quantiles(by: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, **of: float) -> DataFrame:
    """A table by keys with exact quantiles (as of quantile_exact) of the keys' rows beside it, however many rows a key has.

    Values are counted, the counts summed up in order, and the value is picked where they pass the index: a key's window has a row per distinct value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    run = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))
    index = lambda p: F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1)
    picked = run.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.min(F.when(F.col("_upto") > index(p), F.col(value))).alias(name) for name, p in of.items()])
    same = F.lit(True)
    for k in keys:
        same = same & by[k].eqNullSafe(picked[f"_{k}"])
    return by.join(picked, same, "left").drop(*[f"_{k}" for k in keys])


def first_by(columns: Sequence[str], key: str) -> Column:
    """Of a group, the columns of its first row by ``key``; ties go to the smallest values."""
    return F.min(F.struct(key, *columns))


def latest(df: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The newest row of every key."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("r"))
    return newest.select(*keys, "r.*")


def netted(log: DataFrame, sign: str = "sign") -> DataFrame:
    """Rows of a log of assertions and retractions that stand: their signs sum to more than 0."""
    identity = [c for c in log.columns if c != sign]
    return log.groupBy(*identity).agg(F.sum(sign).alias(sign)).where(F.col(sign) > 0)


def carried(x: Column, window) -> Column:
    """The last value that isn't null up to the current row."""
    return F.last(x, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def islands(spans: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Spans [low, high] of whole numbers merged where they overlap or touch, per key: ``run_start``, ``run_end``.

    Works on the spans' ends; nothing is unfolded into single numbers.
    """
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(low) > reach + 1), 1).otherwise(0)
    numbered = spans.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(low).alias("run_start"), F.max(high).alias("run_end")).drop("_run")


def stepped(changes: DataFrame, at: str, change: str, start: int, end: int) -> DataFrame:
    """Running sum of changes as steps over [start, end): ``t``, ``value``, ``next_t``.

    Whatever happened before ``start`` is folded into a step there. One row per time has been summed before
    the only global order, so that step is as long as the window, whatever the log's size.
    """
    spark = changes.sparkSession
    folded = changes.where(F.col(at) < end).groupBy(F.greatest(F.col(at), F.lit(start)).alias("t")).agg(F.sum(change).alias("d"))
    seeded = folded.unionByName(spark.range(1).select(F.lit(start).cast("long").alias("t"), F.lit(0).cast("long").alias("d"))).groupBy("t").agg(F.sum("d").alias("d"))
    order = Window.orderBy("t")
    return seeded.select(
        "t",
        F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("value"),
        F.lead("t", 1).over(order).alias("n"),
    ).select("t", "value", F.coalesce("n", F.lit(end).cast("long")).alias("next_t"))


def dense(steps: DataFrame) -> DataFrame:
    """A row for every whole number of the steps, with the value carried forward: ``t``, ``value``."""
    return steps.where("t < next_t").select(F.explode(F.sequence("t", F.col("next_t") - 1)).alias("t"), "value")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Every left row with the right side's last value at or before it, or null; without a join on ranges."""
    both = left.select(*keys, at, F.lit(1).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select(*keys, at, F.lit(0).alias("_left"), value)
    )
    order = Window.partitionBy(*keys).orderBy(at, "_left")
    return both.withColumn(value, carried(F.col(value), order)).where("_left = 1").drop("_left")
