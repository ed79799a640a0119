"""Reading and writing event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.vocabulary import CONTENT_SCHEMA, EVENT_SCHEMA

#: Columns that older feeds don't have.
OPTIONAL = {"video_resolution": ""}


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw events by the names in the file's header; times are epoch milliseconds."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(EVENT_SCHEMA).csv(path)


def read_content_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(CONTENT_SCHEMA).csv(path)


def land(raw: DataFrame, arrival=None) -> DataFrame:
    """Raw events as the engine reads them; ``arrival`` (seconds) is now unless given, 0 means not observed."""
    for name, value in OPTIONAL.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(value))
    now = F.unix_timestamp(F.current_timestamp()) if arrival is None else arrival
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        F.col("video_session_id").alias("sid"), "user_id", "event_type", text("event").alias("event"), F.col("event_timestamp").alias("ts"), now.cast("long").alias("arrival"),
        F.col("session_start_epoch").alias("session_start"), "content_id", *[text(c).alias(c) for c in ("platform", "country", "app_version", "audio_language", "subtitle_language", "player_version", "video_resolution")],
    )


def inspect(df: DataFrame) -> DataFrame:
    """Columns and types with the number of rows and of nulls, without writing anything."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(c).alias("nulls")) for c, t in df.dtypes]
    return counts.select(F.inline(F.array(*rows)))


def export_slices(events: DataFrame, folder: str, minutes: int = 60) -> None:
    """Events as files per slice of time, for replay in order."""
    events.withColumn("slice", F.floor(F.col("ts") / (60_000 * minutes)).cast("long")).write.mode("overwrite").partitionBy("slice").parquet(folder)


def multiply(events: DataFrame, generations: int, shift_ms: int = 0) -> DataFrame:
    """The events several times over, each generation with ids of its own and moved in time."""
    g = events.sparkSession.range(generations).withColumnRenamed("id", "_g")
    more = events.crossJoin(F.broadcast(g))
    return more.withColumns({
        "sid": F.when(F.col("_g") == 0, F.col("sid")).otherwise(F.concat_ws("-", "sid", F.concat(F.lit("g"), "_g"))),
        "user_id": F.when(F.col("_g") == 0, F.col("user_id")).otherwise(F.concat_ws("-", "user_id", F.concat(F.lit("g"), "_g"))),
        "ts": F.col("ts") + F.col("_g") * shift_ms,
    }).drop("_g")


def replicate(events: DataFrame, cut_ms: int) -> DataFrame:
    """Events up to a cut, both included."""
    return events.where(F.col("ts") <= cut_ms)
