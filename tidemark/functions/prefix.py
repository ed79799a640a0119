"""Running sums and carried values in two levels: within spans of time, and over the spans, of which each is one row.

A global order would pass every row through one task. Here rows meet only those of their own span; what comes before a
span is summed (or carried) over one row a span and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import carried, div


def running_sums(changes: DataFrame, at: str, change: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key and time: the time's own ``change``, ``value`` (the sum of all changes up to it) and ``next_t`` (the key's next time, or null).

    ``width`` is the length of a span in units of ``at``; windows hold the distinct times of a key's span, or its spans.
    """
    per = changes.groupBy(*keys, at).agg(F.sum(change).alias(change)).withColumn("_span", div(F.col(at), width))
    inner, outer = Window.partitionBy(*keys, "_span").orderBy(at), Window.partitionBy(*keys).orderBy("_span")
    rows = per.withColumn("_in", F.sum(change).over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(at).over(inner))
    spans = per.groupBy(*keys, "_span").agg(F.sum(change).alias("_sum"), F.min(at).alias("_first")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_span").alias("_s"),
        F.coalesce(F.sum("_sum").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(outer).alias("_after"),
    )
    same = rows["_span"] == spans["_s"]
    for k in keys:
        same = same & rows[k].eqNullSafe(spans[f"_{k}"])
    return rows.join(spans, same).select(*keys, at, change, (F.col("_in") + F.col("_before")).alias("value"), F.coalesce("_next", "_after").alias("next_t"))


def asof_spans(left: DataFrame, right: DataFrame, at: str, value: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every left row (``keys``, ``at``) with the right side's last ``value`` at or before it, or null; one key's rows need not meet in one task.

    Values of the right side are taken as they are: its last row at a time counts, nulls are passed over.
    """
    both = left.select(*keys, at, F.lit(1).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(*keys, at, F.lit(0).alias("_left"), value))
    both = both.withColumn("_span", div(F.col(at), width))
    inner, outer = Window.partitionBy(*keys, "_span").orderBy(at, "_left"), Window.partitionBy(*keys).orderBy("_s")
    rows = both.withColumn("_in", carried(F.col(value), inner)).where("_left = 1")
    # The last value of every span, and for a span that of the nearest one before that has any.
    last = both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_span").alias("_s")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_last"))
    renamed = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_s") if keys else outer
    spans = last.withColumn("_before", F.last("_last", ignorenulls=True).over(renamed.rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    same = rows["_span"] == spans["_s"]
    for k in keys:
        same = same & rows[k].eqNullSafe(spans[f"_{k}"])
    return rows.join(spans, same).select(*keys, at, F.coalesce("_in", "_before").alias(value))
