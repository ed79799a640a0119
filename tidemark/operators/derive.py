"""From player events to foreground intervals, minute runs and additive deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import carried, div, first_by, islands
from tidemark.vocabulary import DIMS, EVENT_DIMS, PAUSES, RESUMES


def classify(pauses_close: bool = True) -> Column:
    """1 opens watching, 0 closes it, null leaves it as it is."""
    kind, beat = F.col("event_type"), F.col("event")
    heartbeat = kind == "VideoHeartbeat"
    out = F.when(kind.isin("AppBackgrounded", "VideoSessionEnd", "VideoError"), 0)
    if pauses_close:
        out = out.when(heartbeat & beat.isin(*PAUSES), 0)
    return out.when(kind.isin("VideoSessionStart", "VideoPlay", "AppForegrounded") | (heartbeat & beat.isin(*RESUMES)), 1)


def event_state(events: DataFrame) -> DataFrame:
    """One row per session and millisecond, a close beating an open, and the state carried on from the last that decided (open before any)."""
    once = events.groupBy("sid", "ts").agg(F.min(classify(True)).alias("c"), F.min(classify(False)).alias("c_loose"))
    order = Window.partitionBy("sid").orderBy("ts")
    return once.select(
        "sid", "ts", F.coalesce(carried(F.col("c"), order), F.lit(1)).alias("is_open"), F.coalesce(carried(F.col("c_loose"), order), F.lit(1)).alias("is_open_pause_active")
    )


def session_dims(events: DataFrame) -> DataFrame:
    """A session's user and dimensions (of its first event), and its last end (null if none)."""
    cols = ("user_id", *EVENT_DIMS)
    by = events.groupBy("sid").agg(first_by(cols, "ts").alias("f"), F.max(F.when(F.col("event_type") == "VideoSessionEnd", F.col("ts"))).alias("last_end"))
    return by.select("sid", *[f"f.{c}" for c in cols], "last_end")


def catalogue_once(content: DataFrame) -> DataFrame:
    """One row per content, so that a lookup never multiplies rows."""
    rest = [c for c in content.columns if c != "content_id"]
    return content.groupBy("content_id").agg(F.min(F.struct(*rest)).alias("c")).select("content_id", "c.*")


def intervals(events: DataFrame, content: DataFrame, tolerance: int, strict: bool = True) -> DataFrame:
    """Foreground intervals [start, end) in seconds, with the session's user and dimensions."""
    state = "is_open" if strict else "is_open_pause_active"
    order = Window.partitionBy("sid").orderBy("ts")
    open_ = event_state(events).withColumn("next_ts", F.lead("ts").over(order)).where(F.col(state) == 1)
    cap = F.col("ts") + tolerance * 1000
    # least() passes over nulls: no next event and no end leave the tolerance.
    end = F.least("next_ts", cap, "last_end")
    kept = open_.join(session_dims(events), "sid").where("last_end is null or ts < last_end")
    named = kept.join(catalogue_once(content).select("content_id", "video_type"), "content_id", "left")
    return named.select(
        "sid", "user_id", *[F.coalesce("video_type", F.lit("")).alias("video_type") if d == "video_type" else F.col(d) for d in DIMS],
        div(F.col("ts"), 1000).alias("start"), div(end, 1000).alias("end"),
    )


def session_runs(ivs: DataFrame) -> DataFrame:
    """Maximal runs of minutes (both ends included) in which a session was watched."""
    keys = ["sid", "user_id", *DIMS]
    minutes = ivs.select(*keys, div(F.col("start"), 60).alias("low"), div(F.col("start") + F.greatest(F.col("end") - F.col("start") - 1, F.lit(0)), 60).alias("high"))
    return islands(minutes, keys, "low", "high").withColumn("sign", F.lit(1))


def user_runs(runs: DataFrame) -> DataFrame:
    """Runs of a user over all sessions, with the dimensions of the user's earliest run."""
    dims = runs.groupBy("user_id").agg(F.min(F.struct("run_start", "sid", *DIMS)).alias("f")).select("user_id", *[f"f.{d}" for d in DIMS])
    return islands(runs.select("user_id", "run_start", "run_end"), ["user_id"], "run_start", "run_end").join(dims, "user_id").select("user_id", *DIMS, "run_start", "run_end", F.lit(1).alias("sign"))


def deltas(runs: DataFrame) -> DataFrame:
    """+1 where a run starts, -1 in the minute after its end, summed per dimensions and minute."""
    two = F.array(F.struct(F.col("run_start").alias("minute"), F.col("sign").alias("delta")), F.struct((F.col("run_end") + 1).alias("minute"), (-F.col("sign")).alias("delta")))
    return runs.select(*DIMS, F.inline(two)).groupBy(*DIMS, "minute").agg(F.sum("delta").alias("delta")).where("delta != 0")


def openings(spans: DataFrame, low: Column, stop: Column, per_day: int) -> DataFrame:
    """What is open when a day begins: per ``day`` and dimensions the ``value`` that all deltas before it sum up to.

    Made of spans that started before the day and stop (the place of their -1) in it or later, so that only spans over midnight are unfolded.
    """
    over = spans.withColumn("_from", div(low, per_day) + 1).withColumn("_to", div(stop, per_day)).where("_from <= _to")
    return over.select(*DIMS, "sign", F.explode(F.sequence("_from", "_to")).alias("day")).groupBy("day", *DIMS).agg(F.sum("sign").alias("value")).where("value != 0")


def boundary_deltas(ivs: DataFrame) -> DataFrame:
    """The same per second, from intervals that aren't empty."""
    two = F.array(F.struct(F.col("start").alias("second"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("second"), F.lit(-1).alias("delta")))
    return ivs.where("end > start").select(*DIMS, F.inline(two)).groupBy(*DIMS, "second").agg(F.sum("delta").alias("delta")).where("delta != 0")


def naive_runs(events: DataFrame, content: DataFrame, tolerance: int) -> DataFrame:
    """What counting from a session's first to its last event (or end) would claim."""
    span = events.groupBy("sid").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    named = span.join(session_dims(events), "sid").join(catalogue_once(content).select("content_id", "video_type"), "content_id", "left")
    return named.withColumn("video_type", F.coalesce("video_type", F.lit(""))).select("sid", "user_id", *DIMS, div(F.col("a"), 60000).alias("run_start"), div(F.coalesce("last_end", F.col("b")), 60000).alias("run_end"), F.lit(1).alias("sign"))
