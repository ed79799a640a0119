"""Deterministic sessions around one content: an audience that stays, and one that leaves soon after its peak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of sessions, what they do, and from when to when (seconds) it happens.
HEALTHY = (
    (0.75, "end", 1200, 1200), (0.15, "end", 720, 720), (0.05, "end", 360, 360), (0.03, "return", 360, 360), (0.01, "silence", 420, 420), (0.01, "error", 540, 540),
)
WEAK = (
    (0.20, "end", 150, 240), (0.15, "background", 120, 300), (0.10, "silence", 120, 240), (0.20, "end", 300, 480), (0.20, "end", 540, 720), (0.10, "end", 900, 900), (0.05, "error", 120, 300),
)
# Shares of the three waves of arrivals.
WAVES = (0.30, 0.35, 0.35)
CONTENT = 990_001
#: Seconds between heartbeats, between waves, and within which a wave arrives; one event in so many is sent twice.
BEAT, APART, SPREAD, TWICE = 30, 60, 45, 50


def draw(x: str, salt: int, n: int) -> str:
    """A number below n that looks drawn, by arithmetic on x alone, as SQL."""
    return f"((({x} + {salt}) * 2654435761 % 4294967291 * 40503 + {salt} * 7919) % 1000003 % {n})"


def scenario(spark: SparkSession, mix: tuple, start_ms: int, sessions: int = 2000, name: str = "s", content: int = CONTENT) -> DataFrame:
    """Player events of the sessions of a mix; one in fifty comes twice. Which session does what follows from its number."""
    part = (F.col("id") + 0.5) / sessions
    bound, what, low, high = 0.0, F.lit(None).cast("string"), F.lit(0), F.lit(0)
    rows = []
    for share, kind, a, b in mix:
        bound += share
        rows.append((bound, kind, a, b))
    for bound, kind, a, b in reversed(rows):
        inside = part <= bound + 1e-9
        what, low, high = F.when(inside, F.lit(kind)).otherwise(what), F.when(inside, a).otherwise(low), F.when(inside, b).otherwise(high)
    drawn = lambda salt, n: F.expr(draw("id", salt, n))
    wave = F.when(drawn(1, 100) < 100 * WAVES[0], 0).when(drawn(1, 100) < 100 * (WAVES[0] + WAVES[1]), 1).otherwise(2)
    one = spark.range(sessions).select(
        "id", what.alias("what"), (low + drawn(2, 1_000_000) % (high - low + 1)).alias("at"), (F.lit(start_ms) + 1000 * (wave * APART + drawn(3, SPREAD))).alias("t0")
    )
    step = lambda kind, event, at: F.struct(F.lit(kind).alias("event_type"), F.lit(event).alias("event"), at.cast("long").alias("s"))
    at = F.col("at")
    beats = lambda a, b: F.transform(F.sequence(a.cast("long"), b.cast("long"), F.lit(BEAT).cast("long")), lambda s: F.struct(F.lit("VideoHeartbeat").alias("event_type"), F.lit("progress").alias("event"), s.alias("s")))
    end = (
        F.when(F.col("what") == "end", F.array(step("VideoSessionEnd", "", at))).when(F.col("what") == "error", F.array(step("VideoError", "", at))).when(F.col("what") == "background", F.array(step("AppBackgrounded", "", at)))
        .when(F.col("what") == "return", F.concat(F.array(step("AppBackgrounded", "", at), step("AppForegrounded", "", at + 90)), beats(at + 120, at + 690), F.array(step("VideoSessionEnd", "", at + 720))))
        .otherwise(F.array().cast("array<struct<event_type:string,event:string,s:bigint>>"))
    )
    steps = F.concat(F.array(step("VideoSessionStart", "", F.lit(0)), step("VideoPlay", "", F.lit(1))), beats(F.lit(BEAT), at - 1), end)
    rows_ = one.select("id", "t0", F.inline(steps))
    again = F.when(F.expr(draw("id * 10007 + s", 4, TWICE)) == 0, 2).otherwise(1)
    ms = F.col("t0") + 1000 * F.col("s")
    return rows_.withColumn("_n", F.explode(F.sequence(F.lit(1), again))).select(
        F.concat(F.lit(name), F.col("id")).alias("sid"), F.concat(F.lit(f"u{name}"), F.col("id")).alias("user_id"), "event_type", "event", ms.alias("ts"), F.floor(ms / 1000).cast("long").alias("arrival"), F.col("t0").alias("session_start"),
        F.lit(content).cast("long").alias("content_id"), F.lit("Web").alias("platform"), F.lit("IN").alias("country"), F.lit("1").alias("app_version"), *[F.lit("").alias(c) for c in ("audio_language", "subtitle_language", "player_version", "video_resolution")],
    )
