"""Read side of the insight tables: what a dashboard shows for a window and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import div, moment, moment_ms, quantile_exact, with_quantiles
from tidemark.operators import insights as i
from tidemark.operators.dataset import Dataset
from tidemark.operators.serving import Filters, matching


def _pct(part, whole, digits: int):
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def flow(ds: Dataset, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    by = i.minute_snapshot(ds, start, end).where(matching(filters)).groupBy("m").agg(*[F.sum(x).alias(x) for x in i.MEASURES])
    return by.select(moment(F.col("m") * 60).alias("minute"), *i.MEASURES)


def states(log: DataFrame, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    """How often each edge between states stands in a signed log, and the time spent before it."""
    inside = log.where(matching(filters) & (F.col("ts") >= start * 1000) & (F.col("ts") < end * 1000))
    key = ["from_state", "to_state", "sid", "seconds_in_previous_state"]
    net = inside.groupBy(*key).agg(F.sum("sign").alias("n"), F.sum(F.col("seconds_in_previous_state") * F.col("sign")).alias("w"), F.sum(F.when(F.col("trigger_event_type") == "HeartbeatTimeout", F.col("sign")).otherwise(0)).alias("t"))
    per = net.groupBy("from_state", "to_state", "sid").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.when(F.col("n") > 0, F.col("seconds_in_previous_state"))).alias("m"), F.sum("t").alias("t"))
    by = per.groupBy("from_state", "to_state").agg(
        F.sum("n").alias("transitions"), F.count_if(F.col("n") > 0).alias("sessions"), F.round(F.sum("w") / F.greatest(F.sum("n"), F.lit(1)), 1).alias("avg_seconds_in_from_state"),
        F.max("m").alias("max_seconds_in_from_state"), F.sum("t").alias("entered_by_timeout"),
    )
    return by.where("transitions > 0")


def retention(ds: Dataset, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    by = i.entry_cohorts(ds, start, end).where(matching(filters)).groupBy("m").agg(F.sum("entered_sessions").alias("entered_sessions"), *[F.sum(f"active_after_{k}m").alias(f"a{k}") for k in i.RETENTION])
    return by.select(moment(F.col("m") * 60).alias("cohort_minute"), "entered_sessions", *[_pct(F.col(f"a{k}"), F.col("entered_sessions"), 2).alias(f"retention_{k}m_pct") for k in i.RETENTION])


def health(ds: Dataset, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    names = ("active_sessions", "video_error_sessions", "heartbeat_timeout_sessions", "abandoned_sessions")
    by = i.playback_health(ds, start, end).where(matching(filters)).groupBy("m").agg(*[F.sum(n).alias(n) for n in names]).where("active_sessions > 0")
    return by.select(moment(F.col("m") * 60).alias("minute"), *names, *[_pct(F.col(n), F.col("active_sessions"), 3).alias(p) for n, p in zip(names[1:], ("video_error_pct", "timeout_pct", "abandonment_pct"), strict=True)])


def versions(ds: Dataset, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    inside = i.session_facts(ds).where(matching(filters) & (F.col("session_start") >= start * 1000) & (F.col("session_start") < end * 1000))
    n = F.count(F.lit(1))
    has = lambda c: F.count_if(F.col(c) > 0)
    by = inside.groupBy("app_version").agg(
        n.alias("sessions"), *[has(f"active_after_{k}m").alias(f"retained_{k}m") for k in (1, 5, 15)], *[_pct(has(f"active_after_{k}m"), n, 2).alias(f"retention_{k}m_pct") for k in (5, 15)],
        F.round(F.avg("active_seconds"), 1).alias("avg_active_seconds"),
        has("video_error_count").alias("sessions_with_error"), _pct(has("video_error_count"), n, 2).alias("error_session_pct"), has("background_count").alias("sessions_backgrounded"),
        _pct(has("foreground_return_count"), has("background_count"), 2).alias("return_after_background_pct"), has("timed_out").alias("timed_out_sessions"),
    )
    return with_quantiles(by, inside, ["app_version"], "active_seconds", median_active_seconds=0.5, p90_active_seconds=0.9)


def spikes(events: DataFrame, start: int, end: int, limit: int = 200) -> DataFrame:
    """The verdicts on peaks in the window, the latest first."""
    inside = events.where((F.col("peak_minute") >= moment(F.lit(start))) & (F.col("peak_minute") < moment(F.lit(end))))
    return inside.orderBy(F.desc("peak_minute"), F.desc("peak_concurrency"), "content_id").limit(limit)


def _side(value, *columns: str):
    """Whether any of the columns is the value; '' and 0 stand for any value."""
    return F.lit(True) if value in ("", 0, None) else F.greatest(*[F.col(c) == value for c in columns], F.lit(False))


def switching(ds: Dataset, start: int, end: int, limit: int = 200, content_id: int = 0, video_type: str = "") -> DataFrame:
    """Moves between titles, from or to a content, to a video type."""
    kind = F.col("transition_type")
    n, real = F.count(F.lit(1)), F.count_if(kind != "parallel_multi_device")
    wanted = _side(content_id, "from_content_id", "to_content_id") & _side(video_type, "to_video_type")
    moves = i.content_transitions(ds).where(wanted & (F.col("moved_at") >= start) & (F.col("moved_at") < end))
    by = moves.groupBy("from_title", "to_title").agg(
        n.alias("moves"), F.count_distinct("user_id").alias("users"), real.alias("real_switches"), F.count_if(kind == "parallel_multi_device").alias("parallel_viewing"),
        F.count_if(kind == "switch_after_end").alias("after_it_ended"), F.count_if(kind == "switch_after_background").alias("after_backgrounding"), F.count_if(kind == "return_to_previous_content").alias("came_back"),
        _pct(real, n, 1).alias("switch_share_pct"),
    )
    return with_quantiles(by, moves, ["from_title", "to_title"], "gap_seconds", median_gap_seconds=0.5).orderBy(F.desc("moves"), "from_title", "to_title").limit(limit)


def handoff(ds: Dataset, start: int, end: int, limit: int = 200, platform: str = "", content_id: int = 0) -> DataFrame:
    """Moves between devices, from or to a platform, with a content."""
    kind = F.col("transition_type")
    n = F.count(F.lit(1))
    wanted = _side(platform, "from_platform", "to_platform") & _side(content_id, "content_id")
    moves = i.platform_transitions(ds).where(wanted & (F.col("moved_at") >= start) & (F.col("moved_at") < end))
    by = moves.groupBy("from_platform", "to_platform").agg(
        n.alias("moves"), F.count_distinct("user_id").alias("users"), F.count_if(kind == "handoff").alias("handoffs"), F.count_if(kind == "parallel_multi_device").alias("parallel_viewing"),
        F.count_if(kind == "return_to_previous_device").alias("came_back"), _pct(F.count_if(kind == "handoff"), n, 1).alias("handoff_share_pct"),
        F.round(F.avg("overlap_seconds"), 1).alias("avg_overlap_seconds"),
    )
    return with_quantiles(by, moves, ["from_platform", "to_platform"], "gap_seconds", median_gap_seconds=0.5).orderBy(F.desc("moves"), "from_platform", "to_platform").limit(limit)


HORIZON = 15


def forecast(ds: Dataset, start: int, end: int, filters: Filters | None = None, horizon: int = HORIZON) -> DataFrame:
    """The next minutes from the last complete one: median change as drift, 95 % bounds that widen with the root of the distance."""
    observed = i.minute_snapshot(ds, start, end).where(matching(filters)).groupBy("m").agg(F.sum("concurrent_sessions").alias("s"))
    # One row a minute of the window.
    order = Window.orderBy("m")
    change = observed.select("m", "s", (F.col("s") - F.coalesce(F.lag("s").over(order), F.lit(0))).alias("d"), F.lead("m").over(order).alias("after")).where("after is not null")
    fit = change.agg(F.max_by("s", "m").alias("s"), F.max("m").alias("m"), quantile_exact(F.col("d"), 0.5).alias("drift"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("sigma"), F.count(F.lit(1)).alias("n")).where("n > 0")
    h = F.col("minutes_ahead")
    mid, wide = F.col("s") + F.col("drift") * h, 1.96 * F.col("sigma") * F.sqrt(h)
    floor = lambda c: F.greatest(F.lit(0), F.round(c).cast("long"))
    return fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("minutes_ahead")).select(
        moment((F.col("m") + h) * 60).alias("minute"), F.lit("forecast").alias("kind"), floor(mid).alias("sessions"), floor(mid - wide).alias("lower_95"), floor(mid + wide).alias("upper_95"), "minutes_ahead",
        F.col("n").alias("fitted_on_minutes"), F.round(F.col("drift").cast("double"), 2).alias("drift_per_minute"),
    )


def lateness(ds: Dataset, start: int, end: int) -> DataFrame:
    inside = i.late_events(ds.events).where((F.col("ts") >= start * 1000) & (F.col("ts") < end * 1000))
    by = inside.groupBy("lateness_class", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("sid").alias("sessions"), F.round(F.avg("lateness_seconds"), 1).alias("avg_lateness_seconds"),
        F.max("lateness_seconds").alias("max_lateness_seconds"),
    )
    return with_quantiles(by, inside, ["lateness_class", "event_type"], "lateness_seconds", p95_lateness_seconds=0.95).orderBy("lateness_class", F.desc("events"), "event_type")


def status(ds: Dataset, start: int, end: int) -> DataFrame:
    """How far every insight table reaches."""
    parts = [
        ds.events.agg(moment_ms(F.max("ts")).alias("raw_latest"), F.count(F.lit(1)).alias("raw_events")),
        i.session_facts(ds).agg(moment_ms(F.max("session_start")).alias("facts_latest"), F.count_distinct("sid").alias("facts_sessions")),
        i.minute_snapshot(ds, start, end).agg(moment(F.max("m") * 60).alias("snapshot_latest"), F.count_distinct("m").alias("snapshot_minutes")),
        i.state_transitions(ds).agg(moment_ms(F.max("ts")).alias("transitions_latest"), F.sum("sign").alias("transitions_asserted")),
        i.playback_health(ds, start, end).agg(moment(F.max("m") * 60).alias("health_latest")),
        i.entry_cohorts(ds, start, end).agg(moment(F.max("m") * 60).alias("cohorts_latest")),
        i.late_events(ds.events).agg(F.count(F.lit(1)).alias("late_events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def rebucketed(points: DataFrame, grain: int, offset: int = 19_800) -> DataFrame:
    """The highest value per bucket on another zone's clock (5:30 ahead unless told otherwise): ``t`` minutes, ``value``."""
    bucket = div(F.col("t") * 60 + offset, grain) * grain - offset
    return points.groupBy(bucket.alias("b")).agg(F.max("value").alias("concurrency")).select(moment(F.col("b")).alias("bucket"), "concurrency")
