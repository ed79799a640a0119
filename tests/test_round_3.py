"""What the third review found."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_operators import T0, content, events
from tidemark.operators import dataset, diff, insights, refresh, serving
from tidemark.operators.dataset import EVER, Dataset
from tidemark.plans import catalogue
from tidemark.streaming import sessions, tick
from tidemark.streaming.log import Log
from tidemark.vocabulary import DIMS


def test_averages_of_averages_are_rounded_as_whole_numbers(spark):
    """Hours whose averages recombine to a tie that sums of floats fall short of."""
    r = random.Random(2549)
    hours = [(r.randrange(0, 9), r.randrange(0, 60)) for _ in range(24)]  # a value, and the minutes of the hour with one more
    values = [a + (k < more) for a, more in hours for k in range(60)]
    changes = [(t, v - (values[t - 1] if t else 0)) for t, v in enumerate(values)]
    layer = spark.createDataFrame(changes, "minute long, delta long").select("minute", "delta", *[F.lit(8 if d == "content_id" else "x").alias(d) for d in DIMS])
    got = {(x["shape"], x["grain"]): x for x in serving.answers(layer, 0, 86_400).collect()}
    hundredths = [(200 * (60 * a + more) + 60) // 120 for a, more in hours]
    assert sum(hundredths) % 24 == 12
    for shape in ("all", "content"):
        assert got[shape, "hour"]["avg_all_minutes"] == (sum(hundredths) + 12) // 24 / 100
    assert got["platform", "hour"]["avg_active_minutes"] == 0.0


def test_refreshed_tables_are_compared_over_all_of_time(spark, monkeypatch):
    asked = []

    class Insights:
        def verify(self, start, end, tables):
            asked.append((start, end))

    monkeypatch.setattr(catalogue, "_refreshed", lambda spark, d: Insights())
    catalogue.QUERIES["insight_reference_diff"](spark, "")
    assert asked == [EVER]


def test_a_refresh_makes_its_snapshot_once(spark, tmp_path, monkeypatch):
    """Health, spikes and gates read the snapshot that was written, instead of deriving it again."""
    ev = events(spark, *[(f"s{i}", k, "", i * 60 + t) for i in range(6) for k, t in (("VideoPlay", 0), ("VideoSessionEnd", 1200))])
    at = refresh.Insights(Dataset(ev.withColumn("arrival", F.floor(F.col("ts") / 1000).cast("long")), content(spark), 1800), f"file://{tmp_path}")
    held, view = [], refresh.Insights._view
    monkeypatch.setattr(refresh.Insights, "_view", lambda self, *rest: held.append(view(self, *rest)) or held[-1])
    at.build()
    assert held and all("minute_snapshot" in v._held for v in held)
    # Who holds a snapshot makes other tables of it.
    low = T0 // 1000
    snapshot = insights.minute_snapshot(held[0], low, low + 3600)
    held[0]._held["minute_snapshot"] = snapshot.withColumn("concurrent_sessions", F.col("concurrent_sessions") + 100)
    assert insights.playback_health(held[0], low, low + 3600).agg(F.min("active_sessions")).first()[0] >= 100


def test_tables_that_agree_are_read_once(spark):
    a = spark.range(50).select("id", F.col("id").alias("v"))
    one = diff.compared("t", a, a, ["id"])
    assert one.first().asDict() == {"table": "t", "left_rows": 50, "right_rows": 50, "only_left": 0, "only_right": 0}
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_more_files_are_derived_in_more_partitions(spark, tmp_path, monkeypatch):
    ev = events(spark, *[(f"s{i}", "VideoPlay", "", i) for i in range(300)])
    ev.write.parquet(f"file://{tmp_path}/events")
    stored = spark.read.schema(ev.schema).parquet(f"file://{tmp_path}/events")
    monkeypatch.setattr(dataset, "PART_BYTES", 1000)
    ds = Dataset(stored, content(spark), 1800)
    assert ds.parts == dataset.file_bytes(stored) // 1000 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ds.session_runs.rdd.getNumPartitions() == ds.parts and ds.session_runs.count() == 300


@pytest.fixture
def many_parts(spark, tmp_path, monkeypatch):
    """A dataset of 300 sessions, an hour apart, whose files ask for more partitions than the session has."""
    ev = events(spark, *[(f"s{i}", k, "", 3600 * i + t) for i in range(300) for k, t in (("VideoPlay", 0), ("VideoError", 300))])
    ev.write.parquet(f"file://{tmp_path}/events")
    monkeypatch.setattr(dataset, "PART_BYTES", 400)
    return Dataset(spark.read.schema(ev.schema).parquet(f"file://{tmp_path}/events"), content(spark), 1800)


def test_more_files_are_written_by_more_tasks(spark, tmp_path, many_parts):
    """A task's share of what is stored doesn't grow with the input."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ds = many_parts.stored(f"file://{tmp_path}/tables")
    health = insights.playback_health(ds, *EVER)
    assert health.count() == 300 * 6 and health.agg(F.sum("active_sessions"), F.sum("video_error_sessions"), F.sum("abandoned_sessions")).first()[:] == (1500, 300, 300)
    for table in ("intervals", "session_runs", "user_runs", "session_facts", "minute_snapshot", "playback_health"):
        writers = {re.search(r"part-(\d+)", f)[1] for f in spark.read.parquet(f"{ds.place}/{table}").inputFiles()}
        assert own < len(writers), (table, len(writers))


def test_rows_of_one_time_are_written_by_many_tasks(spark):
    """Sessions that were never active have no time to be dealt by."""
    facts = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("sid"), F.concat(F.lit("u"), "id").alias("user_id"), F.lit(0).alias("first_active"))
    most = dataset.in_time_order(facts, 10).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count("p")).first()
    assert most[0] < 4000 and most[1] == 10


def test_health_and_cohorts_are_summed_in_more_partitions(many_parts):
    assert insights.playback_health(many_parts, *EVER).rdd.getNumPartitions() == many_parts.parts
    plan = insights.entry_cohorts(many_parts, *EVER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"Exchange hashpartitioning\(m#\d+L, content_id#\d+L, {many_parts.parts}\)", plan)


def test_a_tick_deals_its_sessions_like_the_events(spark, many_parts):
    ds, low = many_parts, T0
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = tick.session_tick(None, ds.events, ds.content, ds.tolerance, low, low + 3600 * 1000)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert {int(n) for n in re.findall(r"Exchange hashpartitioning\(sid#\d+, (\d+)\)", plan)} == {ds.parts}
        assert sorted(r["sid"] for r in new.collect()) == ["s0", "s1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def random_sessions(spark):
    """Events of 25 sessions, and the same dealt to four batches: out of order within ten minutes, some of them twice, and an event that ends all."""
    r = random.Random(12)
    kinds = [("VideoPlay", ""), ("VideoHeartbeat", "pause"), ("VideoHeartbeat", "progress"), ("VideoHeartbeat", "resume"), ("AppBackgrounded", ""), ("AppForegrounded", ""), ("VideoSessionEnd", ""), ("VideoError", "")]
    data = [(f"s{i % 25}", *r.choice(kinds), r.randrange(0, 4000) + r.choice([0, 0, 0.25])) for i in range(500)]
    dealt = [[], [], [], [], [("nobody", "VideoPlay", "", 10**6)]]
    for e in [*data, *r.sample(data, 50)]:
        dealt[min(int((e[3] + r.randrange(0, 500)) // 1000), 3)].append(e)
    return events(spark, *data), [events(spark, *part) for part in dealt]


def test_states_in_a_log_follow_sessions_like_a_batch(spark, tmp_path):
    whole, batches = random_sessions(spark)
    sliced = batches[0].withColumn("slice", F.lit(0))
    for k, part in enumerate(batches[1:], 1):
        sliced = sliced.unionByName(part.withColumn("slice", F.lit(k)))
    folder = f"file://{tmp_path}"
    catalogue._streamed(spark, sliced, 12, folder, lambda stream: sessions.start(stream, content(spark), f"{folder}/log", 90, 600, fan_in=3))
    want = Dataset(whole, content(spark), 90).intervals
    got = sessions.intervals(spark, f"{folder}/log", content(spark))
    assert sorted(map(str, got.select(want.columns).where("sid != 'nobody'").collect())) == sorted(map(str, want.collect()))
    # A slice of several files was one batch.
    assert len(list(tmp_path.glob("in/slice=1/*.parquet"))) > 1
    assert sorted(p.name for p in tmp_path.glob("log/checkpoint/commits/*") if p.name.isdigit()) == list("01234")
    # States are kept to the newest version and what waits to the last two batches.
    assert len(list(tmp_path.glob("log/events/batch=*"))) == 2


def test_a_batch_of_states_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    whole, batches = random_sessions(spark)
    for k, part in enumerate(batches):
        part.coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    folder, dropped, failed = f"file://{tmp_path}/log", Log.drop, []

    def fails_once(self, batch):
        dropped(self, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("at the end of a batch")

    monkeypatch.setattr(Log, "drop", fails_once)
    run = lambda: sessions.start(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in"), content(spark), folder, 90, 600).awaitTermination()
    with pytest.raises(Exception, match="at the end of a batch"):
        run()
    run()
    want = Dataset(whole, content(spark), 90).intervals
    got = sessions.intervals(spark, folder, content(spark)).select(want.columns).where("sid != 'nobody'")
    assert failed and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_gate_counts_both_sides_once(spark):
    """Runs that stand and runs derived afresh are made once each, and differ where either lacks one or a sign is out of place."""
    ds = Dataset(events(spark, ("s", "VideoPlay", "", 0), ("s", "VideoSessionEnd", "", 200), ("t", "VideoPlay", "", 0)), content(spark), 90)
    runs, touched = ds.session_runs, spark.createDataFrame([("s",)], "sid string")
    fresh = runs.where("sid = 's'").drop("sign")
    assert tick.faults(runs, touched, fresh, "sid") == 0
    assert tick.faults(runs.where("sid = 't'"), touched, fresh, "sid") == 1
    assert tick.faults(runs, touched, fresh.limit(0), "sid") == 1
    assert tick.faults(runs.unionByName(runs), touched, fresh, "sid") == 1
    assert tick.faults(runs.unionByName(runs.withColumn("sign", F.lit(-1))), touched, fresh, "sid") == 1
    calls = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(fresh.rdd.map(lambda r: calls.add(1) or r), fresh.schema)
    assert tick.faults(runs, touched, counted, "sid") == 0 and calls.value == 1


def test_only_distinct_combinations_are_unfolded_for_their_values(spark):
    ds = Dataset(events(spark, *[("s", "VideoPlay", "", 10_000 * i) for i in range(40)]), content(spark), 90)
    plan = serving.dimension_values(ds.deltas, ds.content)._jdf.queryExecution().optimizedPlan().toString()
    # What is unfolded was made distinct.
    below = plan[plan.index("Generate inline"):].splitlines()[1:]
    assert below and below[0].strip(" :+-").startswith("Aggregate")
    assert {(r["dim"], r["label"]) for r in serving.dimension_values(ds.deltas, ds.content).collect()} >= {("content", "a"), ("platform", "Web"), ("country", "IN")}


def test_ticks_read_the_log_that_was_written(spark, monkeypatch):
    """A tick doesn't derive those before it again."""
    logs, retraction = [], tick.retraction
    monkeypatch.setattr(tick, "retraction", lambda log, *rest: logs.append(log) or retraction(log, *rest))
    catalogue.QUERIES["late_tail_absorbed"](spark, "/root/testdata/sf0.001")
    catalogue.QUERIES["two_tick_equals_batch"](spark, "/root/testdata/sf0.001")
    plans = [log._jdf.queryExecution().optimizedPlan().toString() for log in logs]
    assert len(plans) == 3 and all("Window" not in p and "Aggregate" not in p for p in plans)
