"""Running sums and carried values in spans, and layers that are read by the day."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_operators import T0, content, events
from tidemark.functions import core, prefix
from tidemark.operators import serving
from tidemark.operators.dataset import Dataset
from tidemark.vocabulary import DIMS


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_sums_are_those_of_one_order(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", "b", None]), r.randrange(-30, 60), r.randrange(-3, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, d long")
    got = {(x["k"], x["t"]): (x["d"], x["value"], x["next_t"]) for x in prefix.running_sums(df, "t", "d", width, ["k"]).collect()}
    for k in ("a", "b", None):
        times, total = sorted({t for j, t, _ in rows if j == k}), 0
        for t, after in zip(times, [*times[1:], None], strict=True):
            own = sum(d for j, u, d in rows if (j, u) == (k, t))
            total += own
            assert got.pop((k, t)) == (own, total, after)
    assert not got
    assert sum(x["d"] for x in prefix.running_sums(df, "t", "d", width).collect()) == sum(d for *_, d in rows)
    assert prefix.running_sums(df.limit(0), "t", "d", width).count() == 0


@pytest.mark.parametrize("width", [1, 6, 500])
def test_asof_by_spans_is_the_asof_join(spark, width):
    r = random.Random(width)
    left = spark.createDataFrame([(r.choice("ab"), t) for t in range(-5, 60)], "k string, t long")
    right = spark.createDataFrame([(k, r.randrange(0, 50, 3), r.randrange(9)) for k in "aab" for _ in range(4)], "k string, t long, v int").dropDuplicates(["k", "t"])
    want = sorted(map(str, core.asof(left, right, ["k"], "t", "v").collect()))
    assert sorted(map(str, prefix.asof_spans(left, right, "t", "v", width, ["k"]).collect())) == want
    one = [c.where("k = 'a'").drop("k") for c in (left, right)]
    assert sorted((x["t"], x["v"]) for x in prefix.asof_spans(*one, "t", "v", width).collect()) == sorted((x["t"], x["v"]) for x in core.asof(left, right, ["k"], "t", "v").where("k = 'a'").collect())


def nights(spark):
    """Sessions over midnights, several days long, and within a day."""
    return events(
        spark, ("a", "VideoPlay", "", -100), ("b", "VideoPlay", "", -86_400 * 2), ("c", "VideoPlay", "", 86_400 - 60, "iOS"), ("d", "VideoPlay", "", 500), ("d", "VideoSessionEnd", "", 900), ("e", "VideoPlay", "", 86_340 - 200_000),
    )


def test_layers_with_openings_give_what_the_whole_log_gives(spark, tmp_path):
    plain = Dataset(nights(spark), content(spark), 200_000)
    kept = plain.stored(f"file://{tmp_path}/layers")
    assert set(kept.derive_all().values()) == {0}
    t = T0 // 1000
    for low, high in ((t, t + 3600), (t - 600, t + 600), (t + 3600, t + 90_000), (t + 40 * 86_400, t + 40 * 86_400 + 120)):
        for filters in ({}, {"platform": "Web"}, {"platform": "iOS"}):
            for whole, layer in ((plain.deltas, kept.minutes), (plain.user_deltas, kept.user_minutes)):
                a, b = (sorted((r["t"], r["value"]) for r in serving.minute_series(x, low, high, filters).collect()) for x in (whole, layer))
                assert a == b
            a, b = (serving.peak_average_exact(x, low, high, filters).drop("boundaries_in_window").first() for x in (plain.boundaries, kept.seconds))
            assert a == b
    assert kept.minutes.openings.where(F.col("day") == t // 86_400).agg(F.sum("value")).first()[0] == 3
    assert set(kept.minutes.openings.columns) == {"day", "value", *DIMS}


def test_a_window_reads_its_own_days_and_one_opening(spark, tmp_path):
    kept = Dataset(nights(spark), content(spark), 200_000).stored(f"file://{tmp_path}/layers")
    day = T0 // 86_400_000
    plan = serving.curve(kept.minutes, T0 // 1000 + 3600, T0 // 1000 + 7200, {"platform": "Web"})._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert scans and all(re.search(rf"day#\d+L? (>=|<=|=) {day}\b", parts) and "EqualTo(platform,Web)" in pushed for parts, pushed in scans)
    assert not any("session_runs" in line or "intervals" in line for line in plan.splitlines() if "FileScan" in line)


def test_a_broken_opening_is_told(spark, tmp_path):
    kept = Dataset(nights(spark), content(spark), 200_000).stored(f"file://{tmp_path}/layers")
    kept.table("openings", lambda: kept.session_runs.limit(0).select(F.lit(1).cast("long").alias("day"), *DIMS, F.lit(1).cast("long").alias("value")))
    with pytest.raises(ValueError, match="session_openings_differ"):
        kept.derive_all()


def scanned(df):
    """Rows that the only scan of a plan without shuffles gave out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_filters_on_suffix_dimensions_read_the_other_order(spark, tmp_path):
    ev = events(spark, *[(f"s{i}", k, "", 60 * i + t) for i in range(240) for k, t in (("VideoPlay", 0), ("VideoSessionEnd", 90))])
    ev = ev.withColumn("video_resolution", F.concat(F.lit("r"), F.pmod(F.xxhash64("sid"), F.lit(12)).cast("string"))).withColumn("audio_language", F.lit("en"))
    kept = Dataset(ev, content(spark), 90).stored(f"file://{tmp_path}/layers")
    layer, low, high = kept.minutes, T0 // 60_000, T0 // 60_000 + 300
    wanted = F.col("video_resolution") == "r5"
    picked = layer.ordered_for({"video_resolution", "audio_language"})
    mine = scanned(picked.within("minute", low, high).where(wanted))
    assert 0 < mine < 0.5 * scanned(layer.within("minute", low, high).where(wanted)) and picked.changes.where(wanted).count() == layer.changes.where(wanted).count() > 0
    # Leading columns of the first order keep it, and so does no filter.
    for filtered in ({"platform", "video_resolution"}, {"platform"}, {"app_version"}, set()):
        assert layer.ordered_for(filtered) is layer
    a, b = (sorted((r["t"], r["value"]) for r in serving.minute_series(x, T0 // 1000, T0 // 1000 + 18_000, {"video_resolution": "r5"}).collect()) for x in (layer, Dataset(ev, content(spark), 90).deltas))
    assert a == b and max(v for _, v in a) > 0
