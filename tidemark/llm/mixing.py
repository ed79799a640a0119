"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

Within its source each document expects target / size copies. The expected copies are prefix-summed in
order of size, one random offset per source is added, and a document is emitted once for each integer
boundary its interval crosses. Documents of like size lie next to each other, so every stretch of sizes
gives its share and the words taken differ from the target by the largest document or so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: Expected copies are counted in parts of 2**-24, whole numbers, so that sums do not depend on their order.
UNIT = 1 << 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target, n for each source of (source, size) rows.

    Sources in order of code points (null last) take the weights in turn. Targets share all words by weight
    but stop at ``most`` times the source's size; what that leaves over is shared again: in the end every
    source below its cap has the same words per weight, the rate found here by going through the sources in
    the order in which they reach their caps.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rate = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("rate", rate)
    # The first source whose cap is not reached at its rate sets the rate of all.
    found = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("r")))).over(every)
    return by.withColumn("target", F.least(F.col("cap"), F.col("weight") * found["r"])).select("source", "source_size", "target", "n")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 42, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (copies times size), then ``key_cols``.

    Size is the number of words (null text: 0). A null source is a source of its own. A source without words
    has target 0 and takes nothing; rows that repeat an id are documents of their own; an empty table gives
    an empty result. Equal input gives equal results: order is by size and id, then ``key_cols`` (which tell rows
    that repeat an id apart), and the offset of a source is made from its name and the seed.
    """
    words = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long")
    keys = [docs[c].alias(f"key{i}") for i, c in enumerate(key_cols)]
    ties = [F.col("id").asc_nulls_first(), *(F.col(f"key{i}").asc_nulls_first() for i in range(len(keys)))]
    sizes = stage(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words.alias("size"), *keys), "sizes")
    targets = stage(source_targets(sizes.select("source", "size"), weights, most), "targets")
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_first(), F.col("size").desc(), *ties]
    placed = stage(sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order), "placed")
    share = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", share.alias("units"), offset.alias("offset"))
    # A range holds consecutive rows, so what comes before it in a source are that source's earlier ranges.
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("m"))
        .join(targets, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("start", F.coalesce(F.sum(F.col("m") * F.col("units")).over(earlier), F.lit(0)) + F.col("offset"))
        .select("s", F.col("part").alias("p"), "source_size", "target", "units", "start")
    )
    within = Window.partitionBy("part", "source").orderBy(F.col("size").desc(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(ranges, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    upto = F.col("start") + F.sum("units").over(within)
    crossed = run.withColumn("copies", F.shiftright(upto, 24) - F.shiftright(upto - F.col("units"), 24))
    return crossed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"key{i}").alias(c) for i, c in enumerate(key_cols)))
