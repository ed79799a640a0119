"""Logs of streams, and ticks that fail, come late or come early."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_operators import SCHEMA, T0, content, events
from tidemark.functions import core
from tidemark.operators import insights, refresh
from tidemark.operators.dataset import Dataset
from tidemark.streaming import tick
from tidemark.streaming.log import Log


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_compaction_keeps_what_stands_in_few_folders(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", "k string, v int, sign int", "k", buckets=3)
    net, most = Counter(), 0
    for b in range(22):
        new = [(f"k{b % 5}", b, 1)] + ([(f"k{(b - 2) % 5}", b - 2, -1)] if b > 1 else [])
        log.write(b, spark.createDataFrame(new, log.schema))
        net.update({(k, v): s for k, v, s in new if s > 0})
        net.subtract({(k, v): 1 for k, v, s in new if s < 0})
        log.compact(b, fan_in=3)
        most = max(most, len(log.folders()))
        assert sorted((r["k"], r["v"]) for r in core.netted(log.rows()).collect()) == sorted(x for x, n in net.items() if n)
    assert most <= 2 * 3 + 3
    # What cancelled out is gone from the merged folders, and what they replaced is gone as well.
    assert log.rows().count() < 22 and len(log._batches()) <= 7
    held = log.buckets(spark.createDataFrame([("k1", 0, 1)], log.schema))
    assert {r["k"] for r in log.before(22, held).collect()} >= {"k1"} and len(held) == 1
    # A batch that runs again replaces its folder; one that is merged can't be asked for alone.
    log.write(21, spark.createDataFrame([("again", 1, 1)], log.schema))
    assert [r["k"] for r in log.of(21).collect()] == ["again"]
    with pytest.raises(ValueError, match="merged"):
        log.before(1)


def streamed(spark, tmp_path, batches, **more):
    """Run batches of events as a stream, one a tick; the logs."""
    for k, rows_ in enumerate(batches):
        rows_.coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    run = tick.start(stream, content(spark), f"file://{tmp_path}/log", 90, **more)
    run.awaitTermination()
    return tick.logs(spark, f"file://{tmp_path}/log", SCHEMA)


def test_events_that_came_early_are_taken_when_the_clock_is_there(spark, tmp_path):
    early = events(spark, ("early", "VideoPlay", "", 900), ("s", "VideoPlay", "", 0))
    never = events(spark, ("far", "VideoPlay", "", 86_400 * 365), ("t", "VideoPlay", "", 100))
    last = events(spark, ("u", "VideoPlay", "", 7000), ("s", "VideoSessionEnd", "", 30))
    clock = iter([T0, T0 + 60_000, T0 - 5_000_000, T0 + 7_200_000])
    times = list(clock)
    log = streamed(spark, tmp_path, [early, never, events(spark, ("v", "VideoPlay", "", 10)), last], now_ms=lambda b: times[b], fan_in=2)
    want = Dataset(early.unionByName(never.where("sid != 'far'")).unionByName(last).unionByName(events(spark, ("v", "VideoPlay", "", 10))), content(spark), 90)
    assert rows(core.netted(log["runs"].rows())) == rows(want.session_runs)
    assert rows(core.netted(log["user_runs"].rows())) == rows(want.user_runs)
    # Taken once.
    assert log["events"].rows().where("sid = 'early'").count() == 1
    assert log["events"].rows().where("sid = 'far'").count() == 0 and log["future"].rows().where("sid = 'far'").count() == 1


def test_a_gate_heals_once_and_stops_the_stream_when_that_fails(spark, tmp_path, monkeypatch):
    right, calls = tick.sessions_tick, itertools.count()
    ev = [events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoSessionEnd", "", 200))]
    wrong = lambda *a: right(*a).withColumn("run_end", F.col("run_end") + 1)
    monkeypatch.setattr(tick, "sessions_tick", lambda *a: wrong(*a) if next(calls) == 0 else right(*a))
    log = streamed(spark, tmp_path / "once", ev, now_ms=T0 + 10**6, gate=True)
    assert rows(core.netted(log["runs"].rows())) == rows(Dataset(ev[0], content(spark), 90).session_runs) and next(calls) == 2
    monkeypatch.setattr(tick, "sessions_tick", wrong)
    with pytest.raises(Exception, match="differ from a derivation afresh"):
        streamed(spark, tmp_path / "never", ev, now_ms=T0 + 10**6, gate=True)


def test_a_live_loop_refreshes_its_insights(spark, tmp_path):
    folder, names, seen = f"file://{tmp_path}/insights", content(spark), []

    def after(all_events, low, high):
        seen.append((low - T0 // 1000, high - T0 // 1000))
        refresh.Insights(Dataset(all_events, names, 90), folder).refresh(low, high)

    batches = [events(spark, ("s", "VideoPlay", "", 0), ("t", "VideoPlay", "", 50)), events(spark, ("s", "VideoSessionEnd", "", 80_000), ("x", "VideoPlay", "", 70_000)), events(spark, ("t", "VideoError", "", 100), ("x", "VideoError", "", 70_020))]
    streamed(spark, tmp_path, batches, now_ms=T0 + 10**9, after=after)
    assert seen == [(0, 50), (70_000, 80_000), (100, 70_020)]
    whole = Dataset(batches[0].unionByName(batches[1]).unionByName(batches[2]), names, 90)
    at = refresh.Insights(whole, folder)
    assert rows(at.read("session_facts")) == rows(insights.session_facts(whole))
    assert rows(at.read("minute_snapshot")) == rows(insights.minute_snapshot(whole, T0 // 1000 - 86_400, T0 // 1000 + 3 * 86_400))
