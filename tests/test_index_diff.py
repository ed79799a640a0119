"""Spans found by bins, tables compared by digests, intervals appended once, and sessions followed by their state."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import SCHEMA, T0, content, events
from tidemark.functions import bins
from tidemark.operators import diff, serving, settled
from tidemark.operators.dataset import Dataset
from tidemark.operators.snapshots import Store
from tidemark.streaming import sessions


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_bins_find_what_overlaps(spark):
    r = random.Random(4)
    data = [(a, a + n) for a, n in ((r.randrange(-5000, 40_000), r.choice([0, 1, 2, 7, 63, 64, 65, 3000, 30_000])) for _ in range(400))] + [(-(1 << 22), 1 << 22), (0, (1 << 20) - 1), (5, 1 << 20)]
    table = bins.binned(spark.createDataFrame(data, "run_start long, run_end long")).cache()
    for low, high in ((0, 0), (63, 64), (-1, 1), (20_000, 20_010), (4095, 4097), (-4000, 39_000), (1 << 21, 1 << 21), (1 << 23, 1 << 23)):
        got = sorted(tuple(x) for x in table.where(bins.overlapping(low, high)).select("run_start", "run_end").collect())
        assert got == sorted(x for x in data if x[0] <= high and x[1] >= low)
    table.unpersist()


def test_a_window_reads_the_slots_that_can_hold_its_overlaps(spark, tmp_path):
    ev = events(spark, *[(f"s{d}", k, "", d * 86_400 + t) for d in range(40) for k, t in (("VideoPlay", 100), ("VideoSessionEnd", 4000))], ("long", "VideoPlay", "", 0), ("long", "VideoSessionEnd", "", 20 * 86_400))
    kept = Dataset(ev, content(spark), 30 * 86_400).stored(f"file://{tmp_path}/layers")
    low = T0 // 1000 + 10 * 86_400
    got = {r["level"]: r["reach"] for r in serving.reach(kept.session_index, low, low + 7200).collect()}
    assert got == {"sessions": 2, "users": 2}
    # Forty days lie in as many slots; the window's are one or two, and one of the long session.
    (folder,) = (tmp_path / "layers").glob("*/session_index")
    assert len(list(folder.glob("level=*/slot=*"))) > 25
    window = kept.session_index.where(bins.overlapping(low // 60, (low + 7199) // 60))
    read = {r[0].rpartition("/")[0] for r in window.select(F.input_file_name()).distinct().collect()}
    assert len(read) <= 3
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot#" in plan.partition("PartitionFilters: [")[2].partition("PushedFilters")[0]
    listed = window.select(F.col("level"), F.col("slot")).distinct().count()
    assert listed <= 3


def test_tables_are_told_apart_by_digests(spark):
    a = spark.createDataFrame([(i, f"v{i % 7}", None if i % 3 else float(i)) for i in range(500)], "k long, v string, x double")
    assert diff.difference(a, a.repartition(7), ["k"]).count() == 0 and diff.differing_buckets(a, a, ["k"]) == []
    moved = a.where("k != 17").unionByName(spark.createDataFrame([(17, "v3", 17.5), (600, None, None), (8, "v1", None)], a.schema))
    got = sorted((r["k"], r["v"], r["x"], r["side"], r["times"]) for r in diff.difference(a, moved, ["k"]).fillna("-", ["v"]).fillna(-1.0, ["x"]).collect())
    assert got == [(8, "v1", -1.0, "right", 1), (17, "v3", -1.0, "left", 1), (17, "v3", 17.5, "right", 1), (600, "-", -1.0, "right", 1)]
    assert len(diff.differing_buckets(a, moved, ["k"])) <= 3
    one = diff.compared("t", a, moved, ["k"]).first()
    assert (one["left_rows"], one["right_rows"], one["only_left"], one["only_right"]) == (500, 502, 1, 3)
    # Nulls in other columns, and columns in another order.
    n = lambda *rows_: spark.createDataFrame(rows_, "p int, q int")
    assert diff.difference(n((1, None)), n((None, 1)), ["p"]).count() == 2
    assert diff.difference(n((1, None)), n((1, None)).select("q", "p"), ["p"]).count() == 0
    assert diff.difference(n((1, 2)).limit(0), n((1, 2)), ["p"]).first()["side"] == "right"
    with pytest.raises(ValueError, match="different columns"):
        diff.difference(a, n((1, 2)), ["k"])


def test_settled_sessions_are_written_once(spark, tmp_path):
    ev = events(spark, ("a", "VideoPlay", "", 0), ("a", "VideoSessionEnd", "", 40), ("b", "VideoPlay", "", 4000), ("c", "VideoPlay", "", 8000))
    at, s0 = settled.Settled(Store(spark, f"file://{tmp_path}"), content(spark), 90, settle=3600), T0 // 1000
    schema = Dataset(ev, content(spark), 90).intervals.schema
    sids = lambda: sorted(r["sid"] for r in at.intervals(schema).collect())
    assert at.run(ev, s0 + 1000)["number"] == 0
    for as_of, want in ((s0 + 4000, ["a"]), (s0 + 4000, ["a"]), (s0 + 7600, ["a", "b"]), (s0 + 90_000, ["a", "b", "c"])):
        at.run(ev, as_of)
        assert sids() == want
    more = ev.unionByName(events(spark, ("a", "VideoPlay", "", 9000)))
    at.run(more, s0 + 200_000)
    assert sids() == ["a", "b", "c"]
    assert [(r["sid"], r["events"]) for r in at.late(more).collect()] == [("a", 1)]
    # Every run's sessions are new ones.
    listed = at.sessions(spark)
    assert listed.count() == listed.select("sid").distinct().count() == 3
    assert rows(at.intervals(schema)) == rows(Dataset(ev, content(spark), 90).intervals)


def test_state_follows_sessions_like_a_batch(spark, tmp_path):
    r = random.Random(11)
    kinds = [("VideoPlay", ""), ("VideoHeartbeat", "pause"), ("VideoHeartbeat", "progress"), ("VideoHeartbeat", "resume"), ("AppBackgrounded", ""), ("AppForegrounded", ""), ("VideoSessionEnd", ""), ("VideoError", "")]
    data = [(f"s{i % 25}", *r.choice(kinds), r.randrange(0, 4000) + r.choice([0, 0, 0.25])) for i in range(500)]
    whole = events(spark, *data)
    # Within the delay of ten minutes events come in any order, and some twice.
    dealt = [[], [], [], []]
    for e in data:
        dealt[min(int((e[3] + r.randrange(0, 500)) // 1000), 3)].append(e)
        if r.random() < 0.1:
            dealt[min(int((e[3] + r.randrange(0, 500)) // 1000), 3)].append(e)
    for k, part in enumerate([*dealt, [("nobody", "VideoPlay", "", 10**6)]]):
        events(spark, *part).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    spark.conf.set(*sessions.ROCKS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out = sessions.interval_stream(stream, content(spark), 90, "600 seconds")
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(sessions.ROCKS[0])
    want = Dataset(whole, content(spark), 90).intervals
    assert rows(spark.read.schema(want.schema).parquet(f"file://{tmp_path}/out").where("sid != 'nobody'")) == rows(want)
