"""Queries over the delta layers: curves, peaks and averages, reach, open sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bins import overlapping
from tidemark.functions.core import dense, div, first_by, hundredths, moment, moment_ms, netted, quantile_exact, stepped
from tidemark.functions.prefix import running_sums
from tidemark.operators.dataset import Dataset, Layer, window_of
from tidemark.operators.derive import catalogue_once, deltas
from tidemark.vocabulary import DIMS, EVENT_DIMS

Filters = Mapping[str, object]


def matching(filters: Filters | None) -> Column:
    """Conjunction of the filters that are set; '' and 0 stand for any value."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if name not in DIMS:
            raise ValueError(f"unknown dimension {name}")
        if value not in ("", 0, None):
            out = out & (F.col(name) == value)
    return out


def _set(filters: Filters | None) -> set[str]:
    """The dimensions that filters narrow."""
    return {n for n, v in (filters or {}).items() if v not in ("", 0, None)}


def minute_series(layer: DataFrame | Layer, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    """Concurrency of every minute in [start, end) (seconds): ``t`` (minutes), ``value``."""
    return dense(stepped(window_of(layer, "minute", start // 60, end // 60, _set(filters)).where(matching(filters)), "minute", "delta", start // 60, end // 60))


def curve(layer: DataFrame | Layer, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    """Minute by minute concurrency, and the window's figures on every row."""
    series = minute_series(layer, start, end, filters)
    active = F.col("value") > 0
    figures = series.agg(
        F.max("value").alias("peak_concurrency"),
        F.max_by("t", F.struct("value", -F.col("t"))).alias("peak_t"),
        F.round(F.avg("value"), 2).alias("avg_all_minutes"),
        F.coalesce(F.round(F.avg(F.when(active, F.col("value"))), 2), F.lit(0.0)).alias("avg_active_minutes"),
        quantile_exact(F.col("value"), 0.95).alias("p95_concurrency"),
        F.count_if(active).alias("minutes_with_audience"),
        F.count(F.lit(1)).alias("minutes_in_range"),
    )
    return series.crossJoin(F.broadcast(figures)).select(
        moment(F.col("t") * 60).alias("minute"), F.col("value").alias("concurrency"), "peak_concurrency", moment(F.col("peak_t") * 60).alias("peak_minute"),
        "avg_all_minutes", "avg_active_minutes", "p95_concurrency", "minutes_with_audience", "minutes_in_range",
    )


def peak_average(layer: DataFrame | Layer, start: int, end: int, grain: int, filters: Filters | None = None, offset: int = 0) -> DataFrame:
    """Peak and averages per bucket of ``grain`` seconds, always of minute values; ``offset`` moves the buckets to another zone's clock."""
    series = minute_series(layer, start, end, filters)
    active = F.col("value") > 0
    by = series.groupBy((div(F.col("t") * 60 + offset, grain) * grain - offset).alias("b")).agg(
        F.max("value").alias("peak_concurrency"),
        F.max_by("t", F.struct("value", -F.col("t"))).alias("peak_t"),
        F.round(F.avg("value"), 2).alias("avg_all_minutes"),
        F.coalesce(F.round(F.avg(F.when(active, F.col("value"))), 2), F.lit(0.0)).alias("avg_active_minutes"),
        F.count_if(active).alias("minutes_with_audience"),
        F.count(F.lit(1)).alias("minutes_in_bucket"),
    )
    return by.select(moment(F.col("b")).alias("bucket"), "peak_concurrency", moment(F.col("peak_t") * 60).alias("peak_minute"), "avg_all_minutes", "avg_active_minutes", "minutes_with_audience", "minutes_in_bucket")


def peak_average_exact(boundaries: DataFrame | Layer, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    """Peak at second resolution and averages weighted by time."""
    steps = stepped(window_of(boundaries, "second", start, end, _set(filters)).where(matching(filters)), "second", "delta", start, end)
    held = (F.col("next_t") - F.col("t")) * F.col("value")
    live = F.col("value") > 0
    return steps.agg(
        F.max("value").alias("peak_concurrency"),
        moment(F.max_by("t", F.struct("value", -F.col("t")))).alias("peak_at"),
        F.round(F.sum(held) / (end - start), 2).alias("avg_time_weighted"),
        F.coalesce(F.round(F.sum(F.when(live, held)) / F.sum(F.when(live, F.col("next_t") - F.col("t"))), 2), F.lit(0.0)).alias("avg_while_active"),
        F.coalesce(F.sum(F.when(live, F.col("next_t") - F.col("t"))), F.lit(0)).alias("seconds_with_audience"),
        F.count(F.lit(1)).alias("boundaries_in_window"),
    )


#: Name, role and meaning of the averages.
AVERAGES = (
    ("all_minutes", "PRIMARY", "every minute of the range, with the value carried over minutes without a change"),
    ("active_minutes", "alternate", "only minutes that had an audience"),
    ("first_event_to_range_end", "alternate", "from the first minute with an audience to the end of the range"),
)


def average_definitions(layer: DataFrame | Layer, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    series = minute_series(layer, start, end, filters)
    active = F.col("value") > 0
    one = series.agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(active).alias("a"), F.min(F.when(active, F.col("t"))).alias("first"))
    since = F.when(F.col("first").isNull(), F.col("n")).otherwise(F.greatest(F.lit(end // 60) - F.col("first"), F.lit(1)))
    rows = [F.struct(F.lit(d).alias("definition"), F.lit(r).alias("role"), F.round(F.col("s") / F.greatest(n, F.lit(1)), 2).alias("avg_concurrency"), n.cast("long").alias("denominator_minutes"), F.lit(w).alias("what_it_counts")) for (d, r, w), n in zip(AVERAGES, (F.col("n"), F.col("a"), since), strict=True)]
    return one.select(F.inline(F.array(*rows)))


def reach(runs: DataFrame, start: int, end: int, filters: Filters | None = None) -> DataFrame:
    """Distinct sessions and users with a run that overlaps the window; runs with bins are looked up by these."""
    # Minutes m of runs with m * 60 in [start, end).
    low, high = -(-start // 60), (end - 1) // 60
    inside = netted(runs.where((overlapping(low, high) if "bin" in runs.columns else (F.col("run_start") <= high) & (F.col("run_end") >= low)) & matching(filters)))
    one = inside.agg(F.count_distinct("sid").alias("s"), F.count_distinct("user_id").alias("u"))
    return one.select(F.inline(F.array(F.struct(F.lit("sessions").alias("level"), F.col("s").alias("reach")), F.struct(F.lit("users").alias("level"), F.col("u").alias("reach")))))


def open_sessions(events: DataFrame, as_of: int, tolerance: int, limit: int = 50) -> DataFrame:
    """Sessions without an end that still count at ``as_of`` (seconds); totals are of all of them, whatever the limit."""
    cols = ("user_id", *EVENT_DIMS)
    by = events.where(F.col("ts") <= as_of * 1000).groupBy("sid").agg(
        first_by(cols, "ts").alias("f"), F.max("ts").alias("last"), F.count_if(F.col("event_type") == "VideoSessionEnd").alias("ends"), F.count_if(F.col("event_type") == "AppBackgrounded").alias("backgrounds")
    )
    until = div(F.col("last"), 1000) + tolerance
    live = by.where((F.col("ends") == 0) & (until > as_of)).withColumn("until", until).withColumn("provisional_seconds", until - as_of)
    totals = live.agg(F.count(F.lit(1)).alias("open_sessions"), F.sum("provisional_seconds").alias("provisional_seconds_total"), F.count_if(F.col("backgrounds") > 0).alias("open_with_background"))
    top = live.orderBy(F.desc("provisional_seconds"), "sid").limit(limit)
    return top.crossJoin(F.broadcast(totals)).select(
        F.col("sid").alias("video_session_id"), *[f"f.{c}" for c in ("user_id", "platform", "country", "content_id")], moment_ms(F.col("last")).alias("last_event"),
        moment(F.col("until")).alias("counted_until"), "provisional_seconds", "backgrounds", "open_sessions", "provisional_seconds_total", "open_with_background",
    )


def dimension_values(layer: DataFrame, content: DataFrame) -> DataFrame:
    """The values of every dimension, one pass over the layer, of which only distinct combinations are unfolded; contents are labelled by their title."""
    pairs = [F.struct(F.lit("content" if d == "content_id" else d).alias("dim"), F.col(d).cast("string").alias("value")) for d in DIMS]
    values = layer.select(*DIMS).distinct().select(F.inline(F.array(*pairs))).distinct()
    titles = catalogue_once(content).select(F.lit("content").alias("dim"), F.col("content_id").cast("string").alias("value"), "title")
    return values.join(titles, ["dim", "value"], "left").select("dim", "value", F.when(F.coalesce("title", F.lit("")) == "", F.col("value")).otherwise(F.col("title")).alias("label"))


def title_category_peak(ds: Dataset, start: int, end: int, grain: int, title: str = "", category: str = "", show: str = "") -> DataFrame:
    """Peak and averages of the contents with a title, category or show."""
    ids = ds.content
    for column, value in (("title", title), ("category", category), ("show_name", show)):
        if value:
            ids = ids.where(F.col(column) == value)
    return peak_average(ds.minutes.semi(ids.select("content_id").distinct(), "content_id"), start, end, grain).drop("minutes_in_bucket")


def ingest_status(ds: Dataset) -> DataFrame:
    one = lambda df, *cols: df.agg(*cols)
    seen = one(ds.events, F.count(F.lit(1)).alias("events"), moment_ms(F.max("ts")).alias("latest_event"), moment_ms(F.min("ts")).alias("earliest_event"))
    rest = [
        one(ds.session_runs, F.coalesce(F.sum("sign"), F.lit(0)).alias("session_runs")), one(ds.deltas, F.count(F.lit(1)).alias("session_deltas")),
        one(ds.user_runs, F.coalesce(F.sum("sign"), F.lit(0)).alias("user_runs")), one(ds.user_deltas, F.count(F.lit(1)).alias("user_deltas")),
    ]
    for r in rest:
        seen = seen.crossJoin(r)
    return seen


def _peaks(layer: DataFrame, keys: list[str]) -> DataFrame:
    run = running_sums(layer, "minute", "delta", 1440, keys)
    return run.groupBy(*keys).agg(F.max("value").alias("peak"), F.max_by("minute", F.struct("value", -F.col("minute"))).alias("at"))


def peak_is_not_a_rollup(layer: DataFrame, video_type: str, platform: str) -> DataFrame:
    """Four assertions: peaks of parts neither add up to, nor stand where, the peak of all stands."""
    whole = _peaks(layer, []).select(F.col("peak").alias("p"), F.col("at").alias("a"))
    parts = _peaks(layer, ["platform"]).agg(F.max("peak").alias("most"), F.sum("peak").alias("total"))
    kind = _peaks(layer.where(F.col("video_type") == video_type), []).select(F.col("at").alias("ka"))
    own = _peaks(layer.where(F.col("platform") == platform), []).select(F.col("at").alias("pa"))
    all_ = whole.crossJoin(parts).crossJoin(kind).crossJoin(own)
    at = lambda c: moment(F.col(c) * 60).cast("string")
    test = lambda name, a, word, b, ok: F.struct(F.lit(name).alias("assertion"), F.concat(a, F.lit(word), b).alias("observed"), F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))
    text = lambda c: F.col(c).cast("string")
    return all_.select(F.inline(F.array(
        test("peak_minute_differs_by_video_type", at("a"), " vs ", at("ka"), ~F.col("a").eqNullSafe(F.col("ka"))), test("peak_minute_differs_by_platform", at("a"), " vs ", at("pa"), ~F.col("a").eqNullSafe(F.col("pa"))),
        test("overall_peak_exceeds_max_of_parts", text("p"), " vs max part ", text("most"), F.col("p") > F.col("most")), test("overall_peak_differs_from_sum_of_parts", text("p"), " vs sum parts ", text("total"), F.col("p") != F.col("total")),
    )))


#: Filter shapes of the answers matrix.
SHAPES: dict[str, dict[str, object]] = {
    "all": {}, "platform": {"platform": "Web"}, "country": {"country": "IN"}, "content": {"content_id": 8}, "platform+country": {"platform": "Web", "country": "GB"}, "video_type": {"video_type": "live"},
}


GRAINS = {"minute": 60, "hour": 3600, "day": 86400}


def answers(layer: DataFrame | Layer, start: int, end: int) -> DataFrame:
    """Peak and averages of six filter shapes at three grains, in one pass; averages of buckets recombine by their minutes."""
    low, high = start // 60, end // 60
    fits = F.array_compact(F.array(*[F.when(matching(f), name) for name, f in SHAPES.items()]))
    changes = window_of(layer, "minute", low, high).select(F.explode(fits).alias("shape"), F.greatest("minute", F.lit(low)).cast("long").alias("t"), F.col("delta").cast("long").alias("d"))
    seeds = changes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SHAPES))).alias("shape"), F.lit(low).cast("long").alias("t"), F.lit(0).cast("long").alias("d"))
    # A window of minutes per shape.
    order = Window.partitionBy("shape").orderBy("t")
    steps = changes.unionByName(seeds).groupBy("shape", "t").agg(F.sum("d").alias("d")).select(
        "shape", "t", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("value"), F.coalesce(F.lead("t").over(order), F.lit(high).cast("long")).alias("next_t")
    )
    series = steps.where("t < next_t").select("shape", F.explode(F.sequence("t", F.col("next_t") - 1)).alias("t"), "value")
    cells = F.array(*[F.struct(F.lit(name).alias("grain"), div(F.col("t") * 60, g).alias("b")) for name, g in GRAINS.items()])
    n, active = F.count(F.lit(1)), F.count_if(F.col("value") > 0)
    by = series.select("shape", "t", "value", F.inline(cells)).groupBy("shape", "grain", "b").agg(
        F.max(F.struct("value", (-F.col("t")).alias("t"))).alias("p"), hundredths(F.sum("value"), n).alias("a"), F.when(active > 0, hundredths(F.sum(F.greatest("value", F.lit(0))), active)).otherwise(0).alias("aa"), active.alias("w"), n.alias("n")
    )
    # Averages of buckets are whole hundredths, and so is what they recombine to.
    mean = lambda x, w: F.when(F.sum(w) > 0, hundredths(F.sum(F.col(x) * F.col(w)), F.sum(w) * 100) / 100).otherwise(0.0)
    whole = by.groupBy("shape", "grain").agg(
        F.max("p").alias("p"), mean("a", "n").alias("avg_all_minutes"), mean("aa", "w").alias("avg_active_minutes"),
        F.sum("w").alias("minutes_with_audience"), F.sum("n").alias("minutes_total"), F.count(F.lit(1)).alias("buckets"),
    )
    return whole.select("shape", "grain", F.col("p.value").alias("peak_concurrency"), moment(-F.col("p.t") * 60).alias("peak_minute"), "avg_all_minutes", "avg_active_minutes", "minutes_with_audience", "minutes_total", "buckets")


def divergence(ds: Dataset, start: int, end: int) -> DataFrame:
    """How much counting sessions differs from counting people."""
    s = minute_series(ds.minutes, start, end).agg(F.max("value").alias("sp"))
    u = minute_series(ds.user_minutes, start, end).agg(F.max("value").alias("up"))
    r = reach(ds.session_index, start, end).groupBy().pivot("level", ["sessions", "users"]).agg(F.first("reach"))
    return s.crossJoin(u).crossJoin(r).select(
        F.round(100 * (F.col("sp") - F.col("up")) / F.greatest("up", F.lit(1)), 2).alias("peak_gap_pct"), F.round(F.col("sp") / F.greatest("up", F.lit(1)), 4).alias("peak_multiplier"), F.round(F.col("sessions") / F.greatest("users", F.lit(1)), 4).alias("reach_multiplier")
    )
