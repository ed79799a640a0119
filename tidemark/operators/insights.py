"""Tables about audiences: session facts, state transitions, minute snapshots, cohorts, journeys, health, lateness, spikes.

Windows are floored to whole minutes. Every function returns the whole content of its table for the window,
so that a refresh overwrites by key and rows that vanish don't linger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import carried, div, first_by, moment, moment_ms, with_quantiles
from tidemark.operators.dataset import EVER, Dataset, kept, kept_by_minute
from tidemark.operators.derive import catalogue_once
from tidemark.vocabulary import FINAL_AFTER, INSIGHT_DIMS, LATE_AFTER, PAUSES, RESUMES

RETENTION = (1, 5, 10, 15)
SWITCH_GAP, HANDOFF_GAP = 600, 300


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


@kept
def session_facts(ds: Dataset) -> DataFrame:
    """One row per session. Times are milliseconds (first and last activity: seconds), 0 for never."""
    kind, beat = F.col("event_type"), F.col("event")
    heartbeat = kind == "VideoHeartbeat"
    again = kind.isin("VideoSessionStart", "VideoPlay", "AppForegrounded") | (heartbeat & beat.isin(*RESUMES))
    cols = ("user_id", "content_id", "platform", "country", "app_version")
    ev = ds.by_session.groupBy("sid").agg(
        first_by(cols, "ts").alias("f"), F.min("ts").alias("session_start"), F.max("ts").alias("last_event"),
        F.min(F.when(kind == "VideoPlay", F.col("ts"))).alias("first_play"),
        F.max(F.when(kind == "VideoSessionEnd", F.col("ts"))).alias("session_end"), F.min(F.when(kind == "VideoSessionEnd", F.col("ts"))).alias("first_end"),
        F.max(F.when(again, F.col("ts"))).alias("last_again"),
        F.count_if(kind == "AppBackgrounded").alias("background_count"), F.count_if(kind == "AppForegrounded").alias("foreground_return_count"),
        F.count_if(heartbeat & beat.isin(*PAUSES)).alias("pause_count"), F.count_if(heartbeat & beat.isin(*RESUMES)).alias("resume_count"),
        F.count_if(heartbeat).alias("heartbeat_count"), F.count_if(kind == "VideoError").alias("video_error_count"),
    )
    length = F.col("end") - F.col("start")
    # One pass over the session's intervals: retention looks at instants counted from the first start.
    spans = F.collect_list(F.struct("start", "end"))
    # Stored intervals are no longer dealt by session.
    iv = (ds.intervals.repartition(ds.parts, "sid") if ds.folder else ds.intervals).groupBy("sid").agg(
        F.sum(length).alias("active_seconds"), F.count(F.lit(1)).alias("active_interval_count"), F.min("start").alias("first_active"), F.max("end").alias("last_active"),
        F.max_by(length, F.struct("start", "end")).alias("last_length"), spans.alias("spans"),
    )

    def covers(minutes: int) -> Column:
        instant = F.col("first_active") + 60 * minutes
        return F.exists("spans", lambda x: (x["start"] <= instant) & (x["end"] > instant))

    held = [covers(m) for m in RETENTION]
    named = ev.join(iv, "sid", "left").select("*", "f.*").join(catalogue_once(ds.content).select("content_id", "title", "category", "video_type"), "content_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return named.select(
        "sid", "user_id", "content_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "category", "video_type")], "platform", "country", "app_version",
        "session_start", zero("first_play").alias("first_play"), zero("session_end").alias("session_end"), zero("first_active").alias("first_active"), zero("last_active").alias("last_active"),
        zero("active_seconds").alias("active_seconds"), zero("active_interval_count").alias("active_interval_count"), "background_count", "foreground_return_count", "pause_count", "resume_count", "heartbeat_count", "video_error_count",
        _flag(F.col("heartbeat_count") > 0).alias("reached_first_heartbeat"), *[_flag(h).alias(f"active_after_{m}m") for h, m in zip(held, RETENTION, strict=True)],
        _flag(F.col("session_end").isNotNull()).alias("ended_normally"), _flag(F.col("session_end").isNull()).alias("abandoned"), _flag(F.col("last_length") == ds.tolerance).alias("timed_out"),
        _flag(F.col("last_again") > F.col("first_end")).alias("reopened_after_end"), "last_event",
    )


def state_of() -> Column:
    kind, beat = F.col("event_type"), F.col("event")
    heartbeat = kind == "VideoHeartbeat"
    return (
        F.when(kind == "VideoSessionStart", "created").when(kind == "VideoSessionEnd", "ended").when(kind == "VideoError", "error").when(kind == "AppBackgrounded", "background")
        .when(kind.isin("AppForegrounded", "VideoPlay") | (heartbeat & beat.isin(*RESUMES)), "playing_foreground").when(heartbeat & beat.isin(*PAUSES), "paused_foreground")
    )


@kept
def state_transitions(ds: Dataset) -> DataFrame:
    """Edges between states per session and playback instance (a new one after every end), with the seconds spent before each.

    A state that hears nothing for longer than the tolerance goes stale at its end, with trigger HeartbeatTimeout.
    All orders are total: time, then event type and event.
    """
    tol = ds.tolerance
    all_ = Window.partitionBy("sid").orderBy("ts", "event_type", "event")
    ends = F.coalesce(F.sum(F.when(F.col("event_type") == "VideoSessionEnd", 1).otherwise(0)).over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = Window.partitionBy("sid", "instance").orderBy("ts", "event_type", "event")
    points = ds.by_session.select("sid", "ts", "event_type", "event", state_of().alias("raw")).withColumn("instance", ends).select(
        "sid", "instance", "ts", "event_type", "event", F.coalesce(carried(F.col("raw"), one), F.lit("created")).alias("state"), F.lead("ts").over(one).alias("next_ts")
    )
    stale = points.where((F.col("state") != "ended") & (F.col("next_ts").isNull() | (div(F.col("next_ts"), 1000) - div(F.col("ts"), 1000) > tol))).select(
        "sid", "instance", (F.col("ts") + tol * 1000).alias("ts"), F.lit("HeartbeatTimeout").alias("event_type"), F.lit("").alias("event"), F.lit("stale_heartbeat").alias("state")
    )
    total = Window.partitionBy("sid", "instance").orderBy("ts", "state", "event_type", "event")
    edges = points.drop("next_ts").unionByName(stale).withColumn("before", F.lag("state").over(total)).where("before is null or state != before")
    seq = edges.withColumn("prev", F.lag("ts").over(total)).withColumn("n", F.row_number().over(total))
    dims = ds.by_session.groupBy("sid").agg(first_by(("user_id", "content_id", "platform", "country", "app_version"), "ts").alias("f")).select("sid", "f.user_id", "f.content_id", "f.platform", "f.country", "f.app_version")
    named = seq.join(dims, "sid").join(catalogue_once(ds.content).select("content_id", "video_type"), "content_id", "left")
    secs = F.when(F.col("n") == 1, 0).otherwise(F.greatest(div(F.col("ts"), 1000) - div(F.col("prev"), 1000), F.lit(0)))
    return named.select(
        "sid", (F.col("instance") + 1).alias("playback_instance_no"), "user_id", "content_id", "platform", "country", "app_version", F.coalesce("video_type", F.lit("")).alias("video_type"),
        "ts", F.coalesce("before", F.lit("")).alias("from_state"), F.col("state").alias("to_state"), F.col("event_type").alias("trigger_event_type"), F.col("event").alias("trigger_event"),
        secs.cast("long").alias("seconds_in_previous_state"), F.col("n").alias("transition_sequence"), F.lit(1).alias("sign"),
    )


MEASURES = ("concurrent_sessions", "concurrent_users", "session_starts", "first_plays", "session_ends", "foreground_entries", "background_entries", "video_errors")


#: What playback health counts beside the audience; the last one is there for the minutes it makes rows of.
HEALTH = ("error_sessions", "timed_out", "abandoned", "last_active")
#: Partitions of which a day has rows: one in this many, so that a file of a day has rows of many minutes.
PARTS_A_DAY = 4


def _steps(ds: Dataset, start: int, end: int) -> DataFrame:
    """Stretches of minutes [m, next_m) of one day and dimensions with the same audience; whatever else is counted happened in the first minute.

    All sources' changes meet in one shuffle. Nobody is unfolded into minutes, and minutes are only when they are asked for.
    """
    low, high = start // 60, end // 60
    one = F.lit(1).cast("long")

    def watched(runs: DataFrame, name: str) -> DataFrame:
        """The ends of runs, as changes of the size of an audience."""
        a, b, day = F.greatest("run_start", F.lit(low)), F.least("run_end", F.lit(high - 1)), F.col("day")
        # Cut at midnights, so that a window's rows are the minutes of one day.
        cut = runs.where((F.col("run_end") >= low) & (F.col("run_start") < high)).select(*INSIGHT_DIMS, a.alias("a"), b.alias("b"), F.explode(F.sequence(div(a, 1440), div(b, 1440))).alias("day"))
        two = F.array(F.struct(F.greatest("a", day * 1440).alias("m"), one.alias("n")), F.struct((F.least("b", day * 1440 + 1439) + 1).alias("m"), (-one).alias("n")))
        return cut.select(*INSIGHT_DIMS, "day", F.inline(two)).withColumn("what", F.lit(name))

    facts = session_facts(ds)
    inside = lambda m: (m >= low) & (m < high)
    at = lambda m, what, when, n=one: F.struct(m.alias("m"), F.lit(what).alias("what"), F.when(when, n).alias("n"))
    times = [(F.col(c), div(F.col(c), 60000), what) for c, what in (("session_start", "session_starts"), ("first_play", "first_plays"), ("session_end", "session_ends"))]
    last, gone = div(F.col("last_active"), 60), (F.col("last_active") >= start) & (F.col("last_active") < end)
    of_facts = facts.select(*INSIGHT_DIMS, F.inline(F.array(
        *[at(m, what, (c > 0) & inside(m)) for c, m, what in times], at(last, "last_active", gone), *[at(last, c, gone, F.col(c).cast("long")) for c in ("timed_out", "abandoned")],
    )))

    kinds = {"AppForegrounded": "foreground_entries", "AppBackgrounded": "background_entries", "VideoError": "video_errors"}
    what = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    by = ds.by_session.where(F.col("event_type").isin(*kinds)).groupBy("sid", div(F.col("ts"), 60000).alias("m"), "event_type").agg(F.count(F.lit(1)).alias("n")).where(inside(F.col("m")))
    named = by.join(facts.select("sid", *INSIGHT_DIMS), "sid")
    # A session with several errors in a minute fails once in it.
    of_events = named.select(*INSIGHT_DIMS, "m", F.inline(F.array(F.struct(what.alias("what"), F.col("n").alias("n")), F.struct(F.lit("error_sessions").alias("what"), F.when(F.col("event_type") == "VideoError", one).alias("n")))))

    # Runs of one session or user never share a minute, so that sums are what distinct ones would be.
    rows = watched(ds.session_runs, "concurrent_sessions").unionByName(watched(ds.user_runs, "concurrent_users"))
    rows = rows.unionByName(of_facts.unionByName(of_events).where("n > 0").withColumn("day", div(F.col("m"), 1440)))
    keys = ["day", "part", *INSIGHT_DIMS]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*INSIGHT_DIMS), F.lit(max(ds.parts // PARTS_A_DAY, PARTS_A_DAY)))).repartition(ds.parts, "day", "part")
    sums = dealt.groupBy(*keys, "m").agg(*[F.sum(F.when(F.col("what") == x, F.col("n")).otherwise(0)).alias(x) for x in (*MEASURES, *HEALTH)])
    order = Window.partitionBy(*keys).orderBy("m")
    upto = {x: F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) for x in MEASURES[:2]}
    held = (F.col(MEASURES[0]) > 0) | (F.col(MEASURES[1]) > 0)
    any_ = F.greatest(*MEASURES, "last_active") > 0
    steps = sums.withColumns(upto | {"next_m": F.lead("m").over(order)}).where(any_).withColumn("next_m", F.when(held, F.col("next_m")).otherwise(F.col("m") + 1))
    titles = catalogue_once(ds.content).select("content_id", "title", "category")
    return steps.join(titles, "content_id", "left").select("day", "m", "next_m", *INSIGHT_DIMS, *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "category")], *MEASURES, *HEALTH)


def minute_steps(ds: Dataset, start: int, end: int) -> DataFrame:
    """The stretches of _steps that a window [start, end) shows; of all of time where a dataset keeps them."""
    low, high = start // 60, end // 60
    steps = ds.table("minute_steps", lambda: _steps(ds, *EVER)) if ds.drafts("minute_steps") else _steps(ds, start, end)
    return steps.where(F.col("day").between(low // 1440, (high - 1) // 1440) & (F.col("m") < high) & (F.col("next_m") > low))


def _minutes(steps: DataFrame, start: int, end: int, *columns: Column) -> DataFrame:
    """A row for every minute of steps in [start, end): ``m``, these columns and the counts."""
    every = F.sequence(F.greatest("m", F.lit(start // 60)), F.least("next_m", F.lit(end // 60)) - 1)
    counts = [x for x in (*MEASURES, *HEALTH) if x not in MEASURES[:2]]
    return steps.withColumn("t", F.explode(every)).select(F.col("t").alias("m"), *columns, *MEASURES[:2], *[F.when(F.col("t") == F.col("m"), F.col(x)).otherwise(F.lit(0).cast("long")).alias(x) for x in counts])


@kept_by_minute
def minute_snapshot(ds: Dataset, start: int, end: int) -> DataFrame:
    """Eight measures per minute and dimensions over [start, end)."""
    steps = minute_steps(ds, start, end).where(F.greatest(*MEASURES) > 0)
    dims = [F.col(c) for c in ("content_id", "title", "category", "video_type", "platform", "country", "app_version")]
    return _minutes(steps, start, end, *dims).drop(*HEALTH)


@kept_by_minute
def entry_cohorts(ds: Dataset, start: int, end: int) -> DataFrame:
    """Sessions by the minute in which they were first active, and how many still were after some minutes."""
    inside = session_facts(ds).where((F.col("first_active") > 0) & (F.col("first_active") >= start) & (F.col("first_active") < end)).withColumn("m", div(F.col("first_active"), 60)).repartition(ds.parts, "m", "content_id")
    by = inside.groupBy("m", *INSIGHT_DIMS).agg(
        F.min("title").alias("title"), F.min("category").alias("category"), F.count(F.lit(1)).alias("entered_sessions"),
        *[F.sum(f"active_after_{k}m").alias(f"active_after_{k}m") for k in RETENTION],
        *[F.round(F.sum(f"active_after_{k}m") / F.count(F.lit(1)), 6).alias(f"retention_{k}m") for k in RETENTION],
        F.round(F.avg("active_seconds"), 4).alias("avg_active_seconds"),
    )
    # A live event begins for millions in one minute: values are counted, not collected.
    return with_quantiles(by, inside, ["m", *INSIGHT_DIMS], "active_seconds", median_active_seconds=0.5, p90_active_seconds=0.9)


def _journey(facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("first_active", "sid")
    lagged = {f"from_{c}": F.lag(c).over(order) for c in ["sid", *columns, "last_active", "session_end", "background_count"]}
    seq = facts.where("first_active > 0").withColumns(lagged).withColumn("second", F.lag(columns[0], 2).over(order)).where("from_sid is not null")
    gap = F.col("first_active") - F.col("from_last_active")
    overlap = F.greatest(F.lit(0), F.least("from_last_active", "last_active") - F.col("first_active"))
    return seq.withColumn("gap_seconds", gap).withColumn("overlap_seconds", overlap).where(f"from_{columns[0]} != {columns[0]}")


@kept
def content_transitions(ds: Dataset) -> DataFrame:
    """A user's moves from one content to another within ten minutes, or side by side."""
    seq = _journey(session_facts(ds), ["user_id"], ["content_id", "title", "category", "video_type", "platform"]).where((F.col("gap_seconds") <= SWITCH_GAP) | (F.col("overlap_seconds") > 0))
    kind = (
        F.when(F.col("overlap_seconds") > 0, "parallel_multi_device").when(F.col("second") == F.col("content_id"), "return_to_previous_content").when(F.col("from_session_end") > 0, "switch_after_end")
        .when(F.col("from_background_count") > 0, "switch_after_background").otherwise("direct_switch")
    )
    return seq.select(
        "user_id", "from_content_id", "from_title", "from_platform", F.col("content_id").alias("to_content_id"), F.col("title").alias("to_title"), F.col("platform").alias("to_platform"), F.col("video_type").alias("to_video_type"),
        F.col("from_sid").alias("from_session_id"), F.col("sid").alias("to_session_id"), F.col("first_active").alias("moved_at"), "gap_seconds", "overlap_seconds", kind.alias("transition_type"),
    )


@kept
def platform_transitions(ds: Dataset) -> DataFrame:
    """A user's moves between devices with the same content."""
    seq = _journey(session_facts(ds), ["user_id", "content_id"], ["platform"])
    kind = F.when(F.col("overlap_seconds") > 0, "parallel_multi_device").when(F.col("second") == F.col("platform"), "return_to_previous_device").when(F.col("gap_seconds") <= HANDOFF_GAP, "handoff").otherwise("unknown")
    return seq.select(
        "user_id", "content_id", "title", "from_platform", F.col("platform").alias("to_platform"), F.col("from_sid").alias("from_session_id"), F.col("sid").alias("to_session_id"),
        F.col("first_active").alias("moved_at"), "gap_seconds", "overlap_seconds", kind.alias("transition_type"),
    )


@kept_by_minute
def playback_health(ds: Dataset, start: int, end: int) -> DataFrame:
    """Active, failing, timed-out and abandoned sessions per minute and dimensions, with rates."""
    counts = {"active_sessions": MEASURES[0], "video_error_sessions": "error_sessions", "heartbeat_timeout_sessions": "timed_out", "abandoned_sessions": "abandoned"}
    if ds.at_hand("minute_snapshot") and "minute_steps" not in ds._held:
        low, high = start // 60, end // 60
        facts = session_facts(ds)
        zero = F.lit(0).cast("long")
        active = minute_snapshot(ds, start, end).select("m", *INSIGHT_DIMS, F.col("concurrent_sessions").alias("a"), zero.alias("e"), zero.alias("t"), zero.alias("b"))
        minute = div(F.col("ts"), 60000)
        errors = (
            ds.by_session.where((F.col("event_type") == "VideoError") & (minute >= low) & (minute < high)).select("sid", minute.alias("m")).distinct()
            .join(facts.select("sid", *INSIGHT_DIMS), "sid").select("m", *INSIGHT_DIMS, zero.alias("a"), F.lit(1).cast("long").alias("e"), zero.alias("t"), zero.alias("b"))
        )
        out = facts.where((F.col("last_active") >= start) & (F.col("last_active") < end)).select(
            div(F.col("last_active"), 60).alias("m"), *INSIGHT_DIMS, zero.alias("a"), zero.alias("e"), F.col("timed_out").cast("long").alias("t"), F.col("abandoned").cast("long").alias("b")
        )
        # The snapshot has a row a group already, so that sums before the shuffle would save nothing.
        by = active.unionByName(errors).unionByName(out).repartition(ds.parts, "m", "content_id").groupBy("m", *INSIGHT_DIMS).agg(
            F.sum("a").alias("active_sessions"), F.sum("e").alias("video_error_sessions"), F.sum("t").alias("heartbeat_timeout_sessions"), F.sum("b").alias("abandoned_sessions")
        )
    else:
        by = _minutes(minute_steps(ds, start, end), start, end, *map(F.col, INSIGHT_DIMS)).select("m", *INSIGHT_DIMS, *[F.col(x).alias(c) for c, x in counts.items()])
    rate = lambda c: F.round(F.col(c) / F.greatest("active_sessions", F.lit(1)), 6)
    return by.select("*", rate("video_error_sessions").alias("video_error_rate"), rate("heartbeat_timeout_sessions").alias("timeout_rate"), rate("abandoned_sessions").alias("abandonment_rate"))


def lateness(events: DataFrame) -> DataFrame:
    """Every event's seconds between happening and arriving, and its class; arrivals that weren't observed are left out."""
    late = F.col("arrival") - div(F.col("ts"), 1000)
    kind = F.when(late < 0, "invalid_future_event").when(late <= LATE_AFTER, "on_time").when(late <= FINAL_AFTER, "late_acceptable").otherwise("late_after_finalization")
    return events.where("arrival > 0").select(div(F.col("ts"), 86_400_000).alias("day"), "sid", "ts", "arrival", late.alias("lateness_seconds"), kind.alias("lateness_class"), "event_type", "event")


def late_events(events: DataFrame) -> DataFrame:
    """The exceptions: all classes but on_time."""
    return lateness(events).where("lateness_class != 'on_time'")


def spike_candidates(ds: Dataset, start: int, end: int, least_peak: int = 50, least_minutes: int = 10, top: int = 25) -> DataFrame:
    """Contents that peaked high and were watched long enough, the highest first."""
    by = minute_snapshot(ds, start, end).groupBy("content_id", "m").agg(F.sum("concurrent_sessions").alias("c")).groupBy("content_id").agg(F.max("c").alias("peak"), F.count(F.lit(1)).alias("minutes"))
    return by.where((F.col("peak") >= least_peak) & (F.col("minutes") >= least_minutes)).orderBy(F.desc("peak"), "content_id").limit(top)


def daily_spikes(ds: Dataset, start: int, end: int, least_peak: int = 50, least_minutes: int = 10, top: int = 25) -> DataFrame:
    """Verdicts on each day's candidates (the contents that ``spike_candidates`` names for that day), as ``spike_events`` gives them for the day, with ``day``; all days of [start, end) in one pass."""
    snapshot = minute_snapshot(ds, start, end).groupBy(div(F.col("m"), 1440).alias("day"), "content_id", "m").agg(F.sum("concurrent_sessions").alias("c"))
    by = snapshot.groupBy("day", "content_id").agg(F.max("c").alias("peak"), F.count(F.lit(1)).alias("minutes")).where((F.col("peak") >= least_peak) & (F.col("minutes") >= least_minutes))
    # A row per content of a day.
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("peak"), "content_id"))).where(F.col("r") <= top)
    facts = session_facts(ds).where((F.col("session_start") >= start * 1000) & (F.col("session_start") < end * 1000)).withColumn("day", div(F.col("session_start"), 86_400_000))
    return _spikes(snapshot.join(ranked.select("day", "content_id"), ["day", "content_id"], "left_semi"), facts, ["day"])


def spike_events(ds: Dataset, start: int, end: int, contents: DataFrame | None = None) -> DataFrame:
    """Per content: its peak in the window, what held after it, and a verdict; the earliest peak counts."""
    curve = minute_snapshot(ds, start, end).groupBy("content_id", "m").agg(F.sum("concurrent_sessions").alias("c"))
    if contents is not None:
        curve = curve.join(contents.select("content_id"), "content_id", "left_semi")
    return _spikes(curve, session_facts(ds).where((F.col("session_start") >= start * 1000) & (F.col("session_start") < end * 1000)), [])


def _spikes(curve: DataFrame, facts: DataFrame, periods: list[str]) -> DataFrame:
    """Verdicts per content, and period where there are any, from minutes ``m`` with ``c`` sessions and the facts of the sessions that started then."""
    keys = [*periods, "content_id"]
    # Minutes of one content in one window: as many as the window has, at most.
    agg = curve.groupBy(*keys).agg(F.max(F.struct("c", (-F.col("m")).alias("k"))).alias("p"), F.min("m").alias("first"), F.collect_list(F.struct("m", "c")).alias("pts")).select(
        *keys, F.col("p.c").alias("peak"), (-F.col("p.k")).alias("peak_m"), "first", "pts"
    )
    at = lambda k: F.coalesce(F.array_max(F.transform(F.filter("pts", lambda x: x["m"] == F.col("peak_m") + k), lambda x: x["c"])), F.lit(0))
    base = F.coalesce(F.array_min(F.transform(F.filter("pts", lambda x: x["m"] < F.col("peak_m")), lambda x: x["c"])), F.lit(0))
    above = F.size(F.filter("pts", lambda x: (x["m"] >= F.col("peak_m")) & (x["c"] * 100 >= F.col("peak") * 80)))
    sustain = agg.where("peak > 0").select(*keys, "peak", "peak_m", "first", base.alias("baseline"), at(5).alias("after_5"), at(10).alias("after_10"), at(15).alias("after_15"), above.alias("above"))
    outcome = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entered"), F.avg((F.col("background_count") > 0).cast("int")).alias("bg"), F.avg((F.col("video_error_count") > 0).cast("int")).alias("err"), F.avg("timed_out").alias("to")
    )
    pct = lambda c: F.col(c) * 100.0 / F.col("peak")
    r10 = pct("after_10")
    # The bounds of the verdicts.
    verdict = F.when((r10 >= 70) & (F.col("above") >= 8), "healthy_sustained").when((r10 < 55) | (F.col("above") <= 4), "short_lived").otherwise("inconclusive")
    growth = F.when(F.col("baseline") > 0, (F.col("peak") - F.col("baseline")) * 100.0 / F.col("baseline")).otherwise(100.0)
    rate = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    return sustain.join(outcome, keys, "left").select(
        *keys, moment(F.col("first") * 60).alias("window_start"), moment(F.col("peak_m") * 60).alias("peak_minute"), F.col("baseline").alias("baseline_concurrency"), F.col("peak").alias("peak_concurrency"),
        (F.col("peak") - F.col("baseline")).alias("absolute_growth"), F.round(growth, 4).alias("growth_percent"), (F.col("peak_m") - F.col("first")).alias("minutes_to_peak"), F.col("above").alias("minutes_above_80pct_peak"),
        F.col("after_5").alias("concurrency_after_5m"), F.col("after_10").alias("concurrency_after_10m"), F.col("after_15").alias("concurrency_after_15m"),
        *[F.round(pct(f"after_{k}"), 4).alias(f"retention_{k}m_percent") for k in (5, 10, 15)], F.coalesce("entered", F.lit(0)).alias("entered_sessions"),
        rate("bg").alias("background_rate_after_peak"), rate("err").alias("error_rate_after_peak"), rate("to").alias("timeout_rate_after_peak"), verdict.alias("spike_type"),
        F.round(F.least(F.lit(1.0), F.abs(r10 - 62.5) / 37.5), 6).alias("confidence"),
    )


def with_times(df: DataFrame, **columns: str) -> DataFrame:
    """Numbers as times: column=unit, of ms, seconds, minutes or days."""
    unit = {"ms": moment_ms, "seconds": moment, "minutes": lambda c: moment(c * 60), "days": lambda c: moment(c * 86400)}
    return df.withColumns({c: unit[u](F.col(c)) for c, u in columns.items()})
