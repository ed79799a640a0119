"""Rules of the engine on small cases made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import derive, insights, serving, views
from tidemark.operators.dataset import Dataset
from tidemark.streaming import tick
from tidemark.vocabulary import EVENT_DIMS

T0 = 1_704_844_800_000
SCHEMA = "sid string, user_id string, event_type string, event string, ts long, arrival long, session_start long, content_id long, platform string, country string, app_version string, audio_language string, subtitle_language string, player_version string, video_resolution string"


def events(spark, *rows):
    """(session, type, event, second[, platform])"""
    return spark.createDataFrame([(s, f"u-{s}", k, e, T0 + int(1000 * t), 0, T0, 1, (p or ["Web"])[0], "IN", "1", "", "", "", "") for s, k, e, t, *p in rows], SCHEMA)


def content(spark, *rows):
    return spark.createDataFrame(rows or [(1, "a", "vod", "c", "s")], "content_id long, title string, video_type string, category string, show_name string")


def spans(ds):
    return sorted((r["start"] - T0 // 1000, r["end"] - T0 // 1000) for r in ds.intervals.collect())


def test_close_beats_open_within_a_millisecond(spark):
    ev = events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoError", "", 0), ("s", "VideoHeartbeat", "progress", 5))
    assert [r["is_open"] for r in derive.event_state(ev).orderBy("ts").collect()] == [0, 0]


def test_neutral_events_open_before_anything_decides_and_tolerance_caps(spark):
    ds = Dataset(events(spark, ("s", "VideoHeartbeat", "progress", 0), ("s", "VideoHeartbeat", "progress", 200)), content(spark), 90)
    assert spans(ds) == [(0, 90), (200, 290)]


def test_last_end_caps_every_interval(spark):
    ds = Dataset(events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoSessionEnd", "", 30), ("s", "VideoPlay", "", 40), ("s", "VideoSessionEnd", "", 50), ("s", "VideoPlay", "", 60)), content(spark), 90)
    assert spans(ds) == [(0, 30), (40, 50)]


def test_pause_rule_is_a_choice(spark):
    ev = events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoHeartbeat", "pause", 10), ("s", "VideoHeartbeat", "resume", 20))
    assert spans(Dataset(ev, content(spark), 90)) == [(0, 10), (20, 110)]
    assert spans(Dataset(ev, content(spark), 90, strict=False)) == [(0, 10), (10, 20), (20, 110)]


def test_a_minute_touched_only_at_its_start_is_not_claimed(spark):
    ds = Dataset(events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoSessionEnd", "", 60)), content(spark), 90)
    (run,) = ds.session_runs.collect()
    assert run["run_start"] == run["run_end"] == T0 // 60000


def test_empty_interval_claims_its_minute_but_no_second(spark):
    ds = Dataset(events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoError", "", 0.5)), content(spark), 90)
    assert ds.session_runs.count() == 1 and ds.boundaries.count() == 0


def test_repeated_catalogue_rows_do_not_multiply(spark):
    ev = events(spark, ("s", "VideoPlay", "", 0))
    assert Dataset(ev, content(spark, (1, "a", "vod", "c", "s"), (1, "b", "live", "c", "s")), 90).intervals.count() == 1
    assert Dataset(ev, content(spark, (2, "a", "vod", "c", "s")), 90).intervals.first()["video_type"] == ""


def test_first_event_names_the_session(spark):
    ds = Dataset(events(spark, ("s", "VideoPlay", "", 5, "iOS"), ("s", "VideoPlay", "", 1, "Web")), content(spark), 90)
    assert {r["platform"] for r in ds.intervals.collect()} == {"Web"}


def test_curve_is_seeded_and_dense(spark):
    layer = spark.createDataFrame([(10, 1, "Web"), (100, -1, "Web"), (20, 1, "iOS")], "minute long, delta long, platform string")
    got = serving.minute_series(layer, 60 * 60, 64 * 60).orderBy("t").collect()
    assert [(r["t"], r["value"]) for r in got] == [(60, 2), (61, 2), (62, 2), (63, 2)]
    none = serving.curve(layer, 3600, 3660, {"platform": "x"}).first()
    assert (none["concurrency"], none["peak_concurrency"], none["minutes_in_range"]) == (0, 0, 1)


def test_unknown_filter_is_an_error():
    with pytest.raises(ValueError, match="unknown"):
        serving.matching({"colour": "red"})


def test_exact_quantile_is_an_order_statistic(spark):
    df = spark.range(1440)
    assert df.agg(core.quantile_exact(F.col("id"), 0.95)).first()[0] == 1368
    assert df.limit(1).agg(core.quantile_exact(F.col("id"), 0.5)).first()[0] == 0


def test_islands_merge_nested_and_touching_spans(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 3), ("a", 11, 12), ("a", 14, 15)], "k string, low long, high long")
    assert sorted((r["run_start"], r["run_end"]) for r in core.islands(df, ["k"], "low", "high").collect()) == [(1, 12), (14, 15)]


def test_asof_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("a", 9, 3)], "k string, t long, v int")
    assert {(r["k"], r["t"]): r["v"] for r in core.asof(left, right, ["k"], "t", "v").collect()} == {("a", 5): 1, ("a", 0): None, ("b", 5): None}


def test_latest_and_netted(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k string, version int, v string")
    assert core.latest(df, ["k"]).first()["v"] == "z"
    log = spark.createDataFrame([("a", 1), ("a", -1), ("b", 1)], "k string, sign int")
    assert [r["k"] for r in core.netted(log).collect()] == ["b"]


def test_stale_state_is_named_as_a_timeout(spark):
    ds = Dataset(events(spark, ("s", "VideoSessionStart", "", 0), ("s", "VideoPlay", "", 200)), content(spark), 90)
    got = [(r["from_state"], r["to_state"], r["trigger_event_type"]) for r in insights.state_transitions(ds).orderBy("transition_sequence").collect()]
    assert got == [("", "created", "VideoSessionStart"), ("created", "stale_heartbeat", "HeartbeatTimeout"), ("stale_heartbeat", "playing_foreground", "VideoPlay"), ("playing_foreground", "stale_heartbeat", "HeartbeatTimeout")]
    assert views.states(insights.state_transitions(ds), T0 // 1000, T0 // 1000 + 999).agg(F.sum("entered_by_timeout")).first()[0] == 2


@pytest.mark.parametrize(("late", "name"), [(-1, "invalid_future_event"), (0, "on_time"), (90, "on_time"), (91, "late_acceptable"), (3600, "late_acceptable"), (3601, "late_after_finalization")])
def test_lateness_classes(spark, late, name):
    ev = events(spark, ("s", "VideoPlay", "", 0)).withColumn("arrival", F.lit(T0 // 1000 + late).cast("long"))
    assert insights.lateness(ev).first()["lateness_class"] == name


def test_spike_verdicts(spark):
    healthy = [("h%d" % i, k, "", t) for i in range(10) for k, t in (("VideoPlay", 60), ("VideoSessionEnd", 1500))]
    ds = Dataset(events(spark, *healthy), content(spark), 3000)
    row = insights.spike_events(ds, T0 // 1000, T0 // 1000 + 7200).first()
    assert (row["spike_type"], row["peak_concurrency"], row["minutes_above_80pct_peak"]) == ("healthy_sustained", 10, 24)


def test_retraction_heals_any_state_and_leaves_bystanders(spark):
    ev = events(spark, ("s", "VideoPlay", "", 0), ("t", "VideoPlay", "", 500))
    ds = Dataset(ev, content(spark), 90)
    log = ds.session_runs
    wrong = log.unionByName(log).unionByName(log.withColumn("run_end", F.col("run_end") + 7))
    new = tick.session_tick(wrong, ev, ds.content, 90, T0, T0 + 1000)
    assert {r["sid"] for r in new.collect()} == {"s"}
    left = core.netted(wrong.unionByName(new)).where("sid = 's'").collect()
    assert len(left) == 1 and left[0]["run_end"] == T0 // 60000 + 1


def test_empty_events_give_empty_layers(spark):
    ds = Dataset(spark.createDataFrame([], SCHEMA), content(spark), 90)
    assert ds.session_runs.count() == ds.user_deltas.count() == 0
    assert insights.session_facts(ds).count() == 0
    assert len(EVENT_DIMS) == 8


def test_stored_layers_are_read_back_and_hold_their_conditions(spark, tmp_path):
    ev = events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoHeartbeat", "progress", 50), ("s", "VideoSessionEnd", "", 130), ("t", "VideoPlay", "", 40), ("t", "VideoError", "", 70))
    plain = Dataset(ev, content(spark), 90)
    kept = plain.stored(f"file://{tmp_path}/layers")
    assert set(kept.derive_all().values()) == {0}
    for name in ("intervals", "session_runs", "deltas", "boundaries"):
        assert sorted(map(str, getattr(kept, name).select(*getattr(plain, name).columns).collect())) == sorted(map(str, getattr(plain, name).collect()))
    # A table whose writing was broken off is written again.
    (mark,) = (tmp_path / "layers").glob("*/deltas/_SUCCESS")
    mark.unlink()
    assert plain.stored(f"file://{tmp_path}/layers").deltas.count() == plain.deltas.count()


def test_stored_layers_of_other_sources_do_not_meet(spark, tmp_path):
    events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoHeartbeat", "pause", 50)).write.parquet(f"file://{tmp_path}/one")
    events(spark, ("s", "VideoPlay", "", 0)).write.parquet(f"file://{tmp_path}/two")
    one, two = (spark.read.parquet(f"file://{tmp_path}/{x}") for x in ("one", "two"))
    folder, names = f"file://{tmp_path}/layers", content(spark)
    kept = [Dataset(one, names, 90, folder=folder), Dataset(two, names, 90, folder=folder), Dataset(one, names, 60, folder=folder), Dataset(one, names, 90, strict=False, folder=folder), Dataset(one.where("ts > 0"), names, 90, folder=folder)]
    assert [sorted(r["end"] - r["start"] for r in ds.intervals.collect()) for ds in kept] == [[50], [90], [50], [50, 90], [50]]
    assert len({ds.place for ds in kept}) == 5
    # The same source, read anew, finds its tables.
    assert Dataset(spark.read.parquet(f"file://{tmp_path}/one"), names, 90, folder=folder).place == kept[0].place


def test_a_tick_reads_only_the_buckets_of_its_sessions(spark, tmp_path):
    ev = events(spark, *[(f"s{k}", "VideoPlay", "", k) for k in range(60)])
    log = tick.Log(spark, f"file://{tmp_path}/log", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ev.schema), "sid")
    log.write(0, ev)
    one = ev.where("sid = 's7'")
    held = log.buckets(one)
    assert len(held) == 1
    plan = log.before(1, held)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+L? (IN|=)", plan)
    assert log.before(1, held).where("sid = 's7'").count() == 1 and log.before(1).count() == 60


def test_events_from_the_future_are_told_apart(spark):
    ev = events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoPlay", "", 200), ("s", "VideoPlay", "", 400))
    assert ev.where(tick.believable(T0)).count() == 2
