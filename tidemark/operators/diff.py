"""Whether two derivations of a table agree, row by row and as often, told from digests, and where they don't.

Both sides are reduced to a few numbers a bucket: rows, and sums of two hashes of whole rows. Only buckets whose numbers
differ are compared by their rows, so that tables that agree cost one pass each and no shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def row_digest(columns: list[str], salt: int) -> Column:
    # Hashing passes over nulls; flags tell apart where they stood.
    return F.xxhash64(F.lit(salt), *columns, *[F.col(c).isNull() for c in columns])


def _digests(df: DataFrame, columns: list[str], keys: list[str], buckets: int) -> DataFrame:
    bucket = F.pmod(row_digest(keys, 1), F.lit(buckets)).cast("int")
    whole = lambda salt: F.sum(row_digest(columns, salt).cast("decimal(38,0)"))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), whole(2).alias("a"), whole(3).alias("b"))


def _bucketed(df: DataFrame, keys: list[str], buckets: int, of: list[int]) -> DataFrame:
    return df.where(F.pmod(row_digest(keys, 1), F.lit(buckets)).isin(of))


def _told(left: DataFrame, right: DataFrame, keys: list[str], buckets: int) -> list:
    """Per bucket the rows of either side and whether the sides differ, of one pass over each: ``buckets`` rows at most."""
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        raise ValueError(f"tables with different columns: {sorted(set(columns) ^ set(right.columns))}")
    x, y = (_digests(df.select(*columns), columns, keys, buckets) for df in (left, right))
    same = F.col("x.rows").eqNullSafe(F.col("y.rows")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.alias("x").join(y.alias("y"), "bucket", "full").select("bucket", zero("x.rows").alias("left"), zero("y.rows").alias("right"), (~same).alias("differs")).collect()


def differing_buckets(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets of keys in which the sides differ: ``buckets`` numbers at most."""
    return sorted(r["bucket"] for r in _told(left, right, keys, buckets) if r["differs"])


def _between(left: DataFrame, right: DataFrame, keys: list[str], buckets: int, found: list[int]) -> DataFrame:
    columns = sorted(left.columns)
    x, y = (_bucketed(df.select(*columns), keys, buckets, found) for df in (left, right))
    counted = x.withColumn("n", F.lit(1)).unionByName(y.withColumn("n", F.lit(-1))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n != 0")
    return counted.select(*columns, F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").alias("times"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows that one side has more often than the other: the columns, ``side`` ('left', 'right') and ``times``; none where the tables agree."""
    return _between(left, right, keys, buckets, differing_buckets(left, right, keys, buckets))


def compared(name: str, left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row about a pair of tables: rows of either side, and rows that only one has. The tables are read here and now; where they agree, once."""
    told = _told(left, right, keys, buckets)
    found, only = [r["bucket"] for r in told if r["differs"]], {}
    if found:
        only = {r["side"]: r["n"] for r in _between(left, right, keys, buckets, found).groupBy("side").agg(F.sum("times").alias("n")).collect()}
    values = {"left_rows": sum(r["left"] for r in told), "right_rows": sum(r["right"] for r in told), "only_left": only.get("left", 0), "only_right": only.get("right", 0)}
    return left.sparkSession.range(1).select(F.lit(name).alias("table"), *[F.lit(v).cast("long").alias(c) for c, v in values.items()])
