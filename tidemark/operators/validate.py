"""Checks as tables: every metric with its value, what is required, and a verdict where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bins import overlapping
from tidemark.functions.core import div, hundredths, moment, moment_ms, netted
from tidemark.functions.prefix import asof_spans, running_sums
from tidemark.operators.dataset import Dataset, Layer, window_of
from tidemark.operators.derive import catalogue_once, deltas
from tidemark.operators.serving import minute_series
from tidemark.vocabulary import EVENT_TYPES, PAUSES, RESUMES


def _one(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brute_force_curve(ds: Dataset, start: int, end: int) -> DataFrame:
    """Sessions and users per minute by unfolding every interval into minutes and counting: slow, and free of running sums."""
    low, high = start // 60, end // 60
    iv = ds.intervals
    first, last = div(F.col("start"), 60), div(F.col("start") + F.greatest(F.col("end") - F.col("start") - 1, F.lit(0)), 60)
    minutes = iv.where((last >= low) & (first < high)).select("sid", "user_id", F.explode(F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high - 1)))).alias("t"))
    return minutes.groupBy("t").agg(F.count_distinct("sid").alias("concurrent_sessions"), F.count_distinct("user_id").alias("concurrent_users")).select(moment(F.col("t") * 60).alias("minute"), "concurrent_sessions", "concurrent_users")


def users_by_event(ds: Dataset, start: int, end: int) -> DataFrame:
    """Per minute the users that sessions were filed under, and those that the events which opened their intervals named: how far the two readings part."""
    low, high = start // 60, end // 60
    # Of several users at one instant the smallest.
    named = ds.events.groupBy("sid", div(F.col("ts"), 1000).alias("start"), "ts").agg(F.min("user_id").alias("raw")).groupBy("sid", "start").agg(F.min_by("raw", "ts").alias("raw"))
    first, last = div(F.col("start"), 60), div(F.col("start") + F.greatest(F.col("end") - F.col("start") - 1, F.lit(0)), 60)
    minutes = F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high - 1)))
    seen = ds.intervals.where((last >= low) & (first < high)).join(named, ["sid", "start"]).select("sid", "user_id", "raw", F.explode(minutes).alias("t"))
    by = seen.groupBy("t").agg(F.count_distinct("sid").alias("concurrent_sessions"), F.count_distinct("user_id").alias("concurrent_users"), F.count_distinct("raw").alias("concurrent_users_raw"))
    return by.select(moment(F.col("t") * 60).alias("minute"), "concurrent_sessions", "concurrent_users", "concurrent_users_raw")


def overshoot(ds: Dataset) -> DataFrame:
    """Intervals that reach past their session's last end, or hold longer than the tolerance, and by how many seconds at most; none should."""
    ends = ds.events.where("event_type = 'VideoSessionEnd'").groupBy("sid").agg(div(F.max("ts"), 1000).alias("last"))
    both = ds.intervals.join(ends, "sid", "left").select((F.col("end") - F.col("last")).alias("past"), (F.col("end") - F.col("start") - ds.tolerance).alias("over"))
    return both.agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("past") > 0).alias("past_the_last_end"), F.coalesce(F.max(F.greatest("past", F.lit(0))), F.lit(0)).alias("most_seconds_past"), F.count_if(F.col("over") > 1).alias("longer_than_the_tolerance"),
    )


def naive_overcount(ds: Dataset, start: int, end: int) -> DataFrame:
    """What counting whole sessions adds: peaks, percent, and minutes that nobody watched."""
    true = minute_series(ds.minutes, start, end).withColumnRenamed("value", "v")
    naive = minute_series(deltas(ds.naive), start, end).withColumnRenamed("value", "n")
    both = true.join(naive, "t")
    inverted = F.col("n") < F.col("v")
    return both.agg(
        F.max("v").alias("peak"), F.max("n").alias("naive_peak"), F.round(100.0 * (F.max("n") - F.max("v")) / F.greatest(F.max("v"), F.lit(1)), 2).alias("overcount_pct"),
        F.count_if((F.col("v") == 0) & (F.col("n") > 0)).alias("phantom_minutes"), F.count_if(inverted).alias("inverted_minutes"),
    )


def data_quality(ds: Dataset) -> DataFrame:
    """Counts of what is odd in the data, by one pass per grain; nothing is dropped for it."""
    ev, ct = ds.events, ds.content
    kind = F.col("event_type")
    ids = catalogue_once(ct).select("content_id", "video_type")
    named = ev.join(ids.withColumn("known", F.lit(True)), "content_id", "left")
    c = F.count_if

    def rows(df: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
        one = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"c{k}") for k, (_, v) in enumerate(checks)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{k}").alias("n")) for k, (n, _) in enumerate(checks)])))

    sessions = ev.groupBy("sid").agg(c(kind == "VideoSessionStart").alias("s"), c(kind == "VideoSessionEnd").alias("e"), F.count_distinct("platform").alias("p"), F.count_distinct("user_id").alias("u"), F.count_distinct("content_id").alias("k"))
    order = Window.partitionBy("sid").orderBy("ts")
    gaps = ev.select((div(F.col("ts"), 1000) - F.lag(div(F.col("ts"), 1000)).over(order)).alias("g"))
    seconds = ev.groupBy("sid", div(F.col("ts"), 1000).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(ds.deltas, "minute", "delta", 1440).select(F.col("delta").alias("d"), F.col("value").alias("c"))
    return _one([
        rows(named, ("events total", F.count(F.lit(1))), ("events of a negative content", c(F.col("content_id") <= 0)), ("events of a content that is not in the catalogue", c(F.col("known").isNull())),
             ("events of a content without video type", c(F.col("video_type") == "")), ("events before their session's start", c(F.col("session_start") > F.col("ts"))), ("events without a positive time", c(F.col("ts") <= 0)),
             ("backgrounds beyond foregrounds", c(kind == "AppBackgrounded") - c(kind == "AppForegrounded"))),
        rows(ct, ("contents total", F.count(F.lit(1))), ("contents with a negative id", c(F.col("content_id") <= 0))),
        rows(seconds, ("seconds of a session with several events", c(F.col("n") > 1))),
        rows(sessions, ("sessions with several starts", c(F.col("s") > 1)), ("sessions with several ends", c(F.col("e") > 1)), ("sessions without a start", c(F.col("s") == 0)), ("sessions still open", c(F.col("e") == 0)),
             ("sessions on several platforms", c(F.col("p") > 1)), ("sessions of several users", c(F.col("u") > 1)), ("sessions with several contents", c(F.col("k") > 1))),
        rows(gaps, ("gaps of over an hour within a session", c(F.col("g") > 3600))),
        rows(run, ("minutes with negative concurrency", c(F.col("c") < 0)), ("sum of all deltas", F.sum("d"))),
        rows(ds.session_runs, ("runs that end before they start", c(F.col("run_end") < F.col("run_start")))),
    ])


def unknown_vocabulary(events: DataFrame, baseline_before: int) -> DataFrame:
    """Event types outside the closed list, and heartbeat events first seen since ``baseline_before`` (seconds)."""
    decisive = (*PAUSES, *RESUMES)
    out = lambda df, finding, value, context: df.groupBy(F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("sid").alias("sessions"), moment_ms(F.min("ts")).alias("first_seen"), moment_ms(F.max("ts")).alias("last_seen")
    ).select(F.lit(finding).alias("finding"), "value", F.lit(context).alias("context"), "events", "sessions", "first_seen", "last_seen")
    beats = events.where((F.col("event_type") == "VideoHeartbeat") & ~F.col("event").isin(*decisive))
    old = beats.where(F.col("ts") < baseline_before * 1000).select("event").distinct()
    return out(events.where(~F.col("event_type").isin(*EVENT_TYPES)), "UNKNOWN_EVENT_TYPE", "event_type", "").unionByName(out(beats.join(old, "event", "left_anti"), "UNKNOWN_HEARTBEAT_EVENT", "event", "VideoHeartbeat"))


def ground_state(ds: Dataset) -> DataFrame:
    """Volumes, cardinalities and invariants, each as metric and value."""
    n = F.count(F.lit(1))

    def rows(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in metrics.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("metric"), F.col(k).alias("value")) for k in metrics])))

    d = F.count_distinct
    length = F.col("end") - F.col("start")
    return _one([
        rows(ds.events, rows__events=n, uniq__sessions=d("sid"), uniq__users=d("user_id"), uniq__contents=d("content_id"), uniq__event_types=d("event_type"), uniq__events=d("event"), span__first=F.min("ts"), span__last=F.max("ts")),
        rows(ds.intervals, rows__intervals=n, intervals__empty=F.count_if(length == 0), intervals__seconds=F.sum(length), invariant__intervals_inverted=F.count_if(length < 0)),
        rows(ds.session_runs, rows__session_runs=n, runs__minutes=F.sum(F.col("run_end") - F.col("run_start") + 1), invariant__runs_inverted=F.count_if(F.col("run_end") < F.col("run_start"))),
        rows(ds.user_runs, rows__user_runs=n),
        rows(ds.deltas, rows__delta_minutes=d("minute"), invariant__closure_sessions=F.sum("delta")),
        rows(ds.user_deltas, rows__user_delta_minutes=d("minute"), invariant__closure_users=F.sum("delta")),
        rows(ds.session_runs.groupBy("sid", "run_start", "run_end").agg(F.sum("sign").alias("s")), invariant__most_assertions_of_a_run=F.max("s")),
        rows(_reached(ds.session_runs, "sid"), invariant__runs_of_a_session_that_overlap=F.count_if("o")), rows(_reached(ds.user_runs, "user_id"), invariant__runs_of_a_user_that_overlap=F.count_if("o")),
        *[rows(_held(layer), **{f"{name}__{k}": v for k, v in _served().items()}) for name, layer in (("sessions", ds.deltas), ("users", ds.user_deltas))],
    ])


def _reached(runs: DataFrame, key: str) -> DataFrame:
    """Of every standing run whether an earlier one of its key reaches into it."""
    earlier = Window.partitionBy(key).orderBy("run_start", "run_end").rowsBetween(Window.unboundedPreceding, -1)
    return netted(runs).select((F.col("run_start") <= F.max("run_end").over(earlier)).alias("o"))


def _held(layer: DataFrame) -> DataFrame:
    """Counts ``c`` from change to change, and the minutes ``w`` that each holds: curves of changes count changes, not minutes."""
    run = running_sums(layer, "minute", "delta", 1440)
    return run.select("minute", F.col("value").alias("c"), F.coalesce(F.col("next_t") - F.col("minute"), F.lit(0)).alias("w"))


def _served() -> dict[str, Column]:
    """What is served, in whole numbers; averages in hundredths, rounded half up, weighted by the minutes that values hold."""
    c, w = F.col("c"), F.col("w")
    live = lambda x: F.sum(F.when(c > 0, x))
    return {
        "peak": F.max("c"), "peak_minute": F.max_by("minute", F.struct("c", -F.col("minute"))), "least": F.min("c"), "minutes_with_audience": live(w), "minutes_in_span": F.sum("w"),
        "avg_all_minutes_x100": hundredths(F.sum(c * w), F.sum("w")), "avg_active_minutes_x100": hundredths(live(c * w), live(w)),
    }


def runs_deltas_recon(ds: Dataset) -> DataFrame:
    """Minutes at which the runs and the deltas disagree; none should."""
    two = F.array(F.struct(F.col("run_start").alias("minute"), F.col("sign").cast("long").alias("d")), F.struct((F.col("run_end") + 1).alias("minute"), (-F.col("sign")).cast("long").alias("d")))
    runs = ds.session_runs.select(F.inline(two))
    both = runs.unionByName(ds.deltas.select("minute", (-F.col("delta")).alias("d"))).groupBy("minute").agg(F.sum("d").alias("difference"))
    return both.agg(F.count_if(F.col("difference") != 0).alias("minutes_that_differ"), F.count(F.lit(1)).alias("minutes_compared"))


def exact_invariants(ds: Dataset) -> DataFrame:
    """The exact layer nets to zero, is never negative, its sessions don't overlap themselves, and its peak is at most the minute layer's."""
    run = running_sums(ds.boundaries, "second", "delta", 3600).select(F.col("delta").alias("d"), F.col("value").alias("c"))
    own = Window.partitionBy("sid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    over = ds.intervals.select((F.col("start") < F.max("end").over(own)).alias("o")).agg(F.count_if("o").alias("self_overlaps"))
    minute = running_sums(ds.deltas, "minute", "delta", 1440).agg(F.max("value").alias("minute_peak"))
    return run.agg(F.sum("d").alias("net"), F.min("c").alias("least"), F.max("c").alias("exact_peak")).crossJoin(over).crossJoin(minute).withColumn("exact_within_minute", F.col("exact_peak") <= F.col("minute_peak"))


def _changes(layer: DataFrame | Layer, start: int, end: int) -> DataFrame:
    """The layer's own changes in [start, end) seconds."""
    low, high = start // 60, end // 60
    return layer.within("minute", low, high) if isinstance(layer, Layer) else layer.where((F.col("minute") >= low) & (F.col("minute") < high))


def sparse_average(layer: DataFrame | Layer, start: int, end: int) -> DataFrame:
    """Known to be wrong: an average over the minutes that have a change, beside the one over all minutes."""
    sparse = _changes(layer, start, end).select("minute").distinct()
    series = minute_series(layer, start, end)
    right = series.agg(F.round(F.avg("value"), 2).alias("dense_avg"))
    return series.join(sparse, series["t"] == sparse["minute"], "left_semi").agg(F.round(F.avg("value"), 2).alias("sparse_avg")).crossJoin(right)


def unbounded_fill(layer: DataFrame | Layer, start: int, end: int) -> DataFrame:
    """Known to be wrong: a fill from the first to the last change in the window, beside the bounded one."""
    inside = _changes(layer, start, end).agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    series = minute_series(layer, start, end)
    cut = series.crossJoin(F.broadcast(inside)).where("t between a and b").agg(F.round(F.avg("value"), 2).alias("unbounded_avg"), F.count(F.lit(1)).alias("unbounded_minutes"))
    return cut.crossJoin(series.agg(F.round(F.avg("value"), 2).alias("bounded_avg"), F.count(F.lit(1)).alias("bounded_minutes")))


def gap_profile(events: DataFrame) -> DataFrame:
    """Quantiles (interpolated) of the milliseconds between a session's events."""
    order = Window.partitionBy("sid").orderBy("ts")
    gap = events.select((F.col("ts") - F.lag("ts").over(order)).alias("g")).where("g is not null")
    q = lambda p: F.round(F.percentile("g", F.lit(p)), 3)
    return gap.agg(F.count(F.lit(1)).alias("gaps"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("g").alias("longest"))


def orphan_contents(ds: Dataset) -> DataFrame:
    """Contents that events name and the catalogue doesn't have."""
    return ds.events.groupBy("content_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("sid").alias("sessions")).join(ds.content, "content_id", "left_anti")


def duplicate_events(events: DataFrame) -> DataFrame:
    """How many groups of events agree in session, time, type and event, and the rows beyond the first."""
    by = events.groupBy("sid", "ts", "event_type", "event").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return by.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def locf_average(layer: DataFrame | Layer, start: int, end: int, step: int = 600) -> DataFrame:
    """Averages of samples every ``step`` seconds: the last value carried to them, and zero where no change is exactly there."""
    low, high = start // 60, end // 60
    run = running_sums(window_of(layer, "minute", low, high), "minute", "delta", 1440).select(F.col("minute").alias("t"), F.col("value").alias("v"))
    grid = run.sparkSession.range(low, high, step // 60).select(F.col("id").alias("t"))
    changed = _changes(layer, start, end).select(F.col("minute").alias("t")).distinct()
    held = asof_spans(grid, run, "t", "v", 1440).join(run.withColumnRenamed("v", "hit").join(changed, "t", "left_semi"), "t", "left")
    return held.agg(F.round(F.avg(F.coalesce("v", F.lit(0))), 2).alias("locf_avg"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 2).alias("zero_fill_avg"), F.count(F.lit(1)).alias("samples"))


def straddling_sessions(events: DataFrame, boundary: int) -> DataFrame:
    """Sessions with events on both sides of a time (seconds)."""
    by = events.groupBy("sid").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("events"))
    return by.where((F.col("a") < boundary * 1000) & (F.col("b") >= boundary * 1000)).select(F.col("sid").alias("video_session_id"), "events")


def naive_at(ds: Dataset, at: int) -> DataFrame:
    """One minute: sessions whose whole span covers it, and those that were watched."""
    m = at // 60
    covers = lambda df: netted(df.where(overlapping(m, m))).agg(F.count_distinct("sid").alias("n"))
    return covers(ds.naive_index).select(F.col("n").alias("naive")).crossJoin(covers(ds.session_index).select(F.col("n").alias("foreground")))
