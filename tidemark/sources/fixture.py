"""Player events and a catalogue made from the general ``events`` and ``part`` tables, by rules on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dataset import Dataset

TOLERANCE = 1800


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(({index}) % {len(values)} as int) + 1)"


def player_events(events: DataFrame) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    e, u = "event_id", "user_id"
    beat = _pick(("pause", "resume", "AdPause", "AdResume", "speed-pause", "speed-resume", "", "buffer", "progress", "progress", "seek", "progress"), e)
    kind = (
        f"case when {e} % 10 = 3 then 'AppBackgrounded' when {e} % 10 = 7 then 'AppForegrounded' when {e} % 23 = 5 then 'VideoSessionEnd' "
        f"when event_type = 'signup' then 'VideoSessionStart' when event_type = 'view' then 'VideoPlay' "
        f"when event_type = 'error' and {e} % 4 = 0 then 'VideoError' else 'VideoHeartbeat' end"
    )
    made = events.select(
        # Sessions go from noon to noon, over midnight.
        e, F.expr(f"concat('u', {u}, '-', date_format(ts + interval 12 hours, 'yyyyMMdd'))").alias("sid"),
        F.expr(f"concat('u', case when {e} % 41 = 0 then {u} + 1 else {u} end)").alias("uid"),
        F.expr(kind).alias("kind"), F.expr(beat).alias("beat"), F.expr("unix_millis(cast(ts as timestamp))").alias("ms"),
        F.expr(f"1 + ({u} * 7 + case when {e} % 31 = 0 then 1 else 0 end) % 40").alias("content_id"),
        F.expr(_pick(("Android", "iOS", "Web", "SmartTV"), f"{u} + case when {e} % 17 = 0 then 1 else 0 end")).alias("platform"),
        F.expr(_pick(("IN", "US", "GB", "AE", "SG"), u)).alias("country"),
        F.expr(_pick(("1.0", "1.1", "2.0"), u)).alias("app_version"),
        F.expr(_pick(("hi", "en", ""), f"{u} + {e} % 2")).alias("audio_language"),
        F.expr(_pick(("en", ""), u)).alias("subtitle_language"),
        F.expr(_pick(("p1", "p2"), f"{u} + 1")).alias("player_version"),
        F.expr(_pick(("1080p", "720p", "4K"), f"{u} + 2")).alias("video_resolution"),
        F.expr(f"case {e} % 20 when 0 then -3600 when 1 then 600 when 2 then 7200 else 10 end").alias("late"), F.expr(f"{e} % 20 = 3").alias("unseen"),
    )
    return made.select(
        F.col("sid"), F.col("uid").alias("user_id"), F.col("kind").alias("event_type"), F.expr("case when kind = 'VideoHeartbeat' then beat else '' end").alias("event"),
        F.col("ms").alias("ts"), F.expr("case when unseen then 0 else floor(ms / 1000) + late end").cast("long").alias("arrival"), F.expr("floor((ms + 43200000) / 86400000) * 86400000 - 43200000").cast("long").alias("session_start"),
        "content_id", "platform", "country", "app_version", "audio_language", "subtitle_language", "player_version", "video_resolution",
    )


def catalogue(part: DataFrame) -> DataFrame:
    return part.where("p_partkey <= 40 and p_partkey % 9 != 0").select(
        F.col("p_partkey").alias("content_id"), F.col("p_name").alias("title"), F.expr(_pick(("vod", "live", "vod", ""), "p_partkey")).alias("video_type"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("show_name"),
    )


def load(spark: SparkSession, sf_dir: str, tolerance: int = TOLERANCE, strict: bool = True) -> Dataset:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return Dataset(player_events(read("events")), catalogue(read("part")), tolerance, strict)
