"""Snapshots of stored tables, and their refresh by touched sessions."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import T0, content, events
from tidemark.operators import insights, refresh
from tidemark.operators.dataset import Dataset
from tidemark.operators.snapshots import MOST_VERSIONS, Store, _named

S0 = T0 // 1000


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def batch(ds, name):
    """What a table holds when everything is derived at once."""
    if name in refresh.BY_DAY:
        make, day, _ = refresh.BY_DAY[name]
        return make(ds, S0 - 9 * 86_400, S0 + 9 * 86_400).drop("day")
    return ds.user_runs if name == "user_runs" else (refresh.BY_SESSION | refresh.BY_USER)[name][0](ds)


HISTORY = (
    ("night", "VideoPlay", "", -3600), ("night", "VideoHeartbeat", "progress", -3000), ("calm", "VideoPlay", "", -90_000, "iOS"), ("calm", "VideoSessionEnd", "", -89_000, "iOS"), ("other", "VideoPlay", "", 300),
)
#: Two hours after midnight: an error, the end, and an event a day late.
NEWS = (("night", "VideoError", "", 7200), ("night", "VideoSessionEnd", "", 7300), ("calm", "AppBackgrounded", "", -89_500, "iOS"), ("new", "VideoPlay", "", 7000), ("other", "VideoHeartbeat", "progress", 600))


def both(spark):
    old = events(spark, *HISTORY).withColumn("arrival", F.floor(F.col("ts") / 1000).cast("long"))
    return old, old.unionByName(events(spark, *NEWS).withColumn("arrival", F.lit(S0 + 7400).cast("long")))


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('insights')}"
    old, all_ = both(spark)
    names = content(spark)
    first = refresh.Insights(Dataset(old, names, 90), folder)
    first.build()
    new = refresh.Insights(Dataset(all_, names, 90), folder)
    new.refresh(S0 + 6000, S0 + 8000)
    return first, new


@pytest.mark.parametrize("name", ["session_facts", "state_transitions", "session_runs", "user_runs", *refresh.BY_USER, *refresh.BY_DAY])
def test_refreshed_tables_are_those_of_a_batch(spark, refreshed, name):
    old, new = refreshed
    made = new.read(name)
    assert rows(made) == rows(batch(new.ds, name).select(*made.columns))
    # Who reads the snapshot of before still has it.
    assert rows(new.read(name, number=1)) == rows(batch(old.ds, name).select(*made.columns))


def test_a_session_over_midnight_gets_its_error_and_end(refreshed):
    night = refreshed[1].read("session_facts").where("sid = 'night'").first()
    assert (night["video_error_count"], night["ended_normally"], night["abandoned"]) == (1, 1, 0)


def test_a_refresh_touches_what_changed_and_again_changes_nothing(spark, refreshed):
    store, new = refreshed[1].store, refreshed[1]
    (one, two) = (store.manifest(n)["tables"] for n in (1, 2))
    touched = spark.read.parquet(two["session_facts"]["versions"][-1]["keys"])
    assert {r["sid"] for r in touched.collect()} == {"night", "calm", "new", "other"}
    version = spark.read.parquet(two["session_facts"]["versions"][-1]["rows"])
    assert version.count() == 4 and two["session_facts"]["versions"][0] == one["session_facts"]["versions"][0]
    before = {n: rows(new.read(n)) for n in ("session_facts", "minute_snapshot")}
    new.refresh(S0 + 6000, S0 + 8000)
    assert {n: rows(new.read(n)) for n in before} == before
    # Nothing is new, nothing is committed.
    number = store.manifest()["number"]
    new.refresh(S0 + 90_000, S0 + 91_000)
    assert store.manifest()["number"] == number


def test_days_that_nothing_touched_keep_their_files(refreshed):
    one, two = (refreshed[1].store.manifest(n)["tables"]["minute_snapshot"]["days"] for n in (1, 2))
    day = str(S0 // 86_400)
    assert two[day] != one[day] and set(two) >= set(one)


def test_a_refused_refresh_and_one_that_breaks_off_leave_what_stood(spark, tmp_path, monkeypatch):
    old, all_ = both(spark)
    folder, names = f"file://{tmp_path}", content(spark)
    at = refresh.Insights(Dataset(old, names, 90), folder)
    at.build()
    before = {n: rows(at.read(n)) for n in ("session_facts", "minute_snapshot", "user_runs")}
    new = refresh.Insights(Dataset(all_, names, 90), folder)
    make, day, _ = refresh.BY_DAY["minute_snapshot"]
    monkeypatch.setitem(refresh.BY_DAY, "minute_snapshot", (make, day, ["country"]))
    with pytest.raises(ValueError, match="minute_snapshot_repeats_a_key"):
        new.refresh(S0 + 6000, S0 + 8000)
    monkeypatch.undo()

    def breaks(self, manifest, name, *rest, write=Store.replaced):
        if name == "playback_health":
            raise OSError("lost")
        return write(self, manifest, name, *rest)

    monkeypatch.setattr(Store, "replaced", breaks)
    with pytest.raises(OSError, match="lost"):
        new.refresh(S0 + 6000, S0 + 8000)
    monkeypatch.undo()
    assert {n: rows(at.read(n)) for n in before} == before
    # A rebuild is one switch for all tables, and can be undone.
    new.build()
    assert rows(new.read("session_facts")) == rows(insights.session_facts(new.ds))
    new.store.roll_back(1)
    assert {n: rows(new.read(n)) for n in before} == before
    new.store.clean(keep=1)
    assert {n: rows(new.read(n)) for n in before} == before and new.store.numbers() == [3]
    named = {p.rpartition("/")[2] for p in _named(new.store.manifest()["tables"])}
    assert named == {p.name for p in (tmp_path / "data").iterdir()} and len(named) >= 7


def test_two_writers_cannot_both_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    start = store.manifest()
    store.commit(start, {"t": {"days": {}}})
    with pytest.raises(RuntimeError, match="somebody else"):
        store.commit(start, {})
    assert store.manifest()["tables"] == {"t": {"days": {}}} and not list((tmp_path / "manifests").glob("draft*"))


def test_versions_are_merged_and_the_newest_counts(spark, tmp_path):
    store, want = Store(spark, f"file://{tmp_path}"), {}
    for k in range(MOST_VERSIONS + 3):
        mine = {f"k{(k * 3 + i) % 7}" for i in range(3)}
        keys = store.write("keys", spark.createDataFrame([(x,) for x in mine], "k string")) if k else None
        data = [(x, k) for x in sorted(mine)[1:]]  # the first one has no rows now
        want = {x: v for x, v in want.items() if x not in mine} | dict(data)
        before = store.manifest()
        entry = store.upserted(before, "t", "k", spark.createDataFrame(data, "k string, v int"), keys)
        store.commit(before, {"t": entry})
        assert dict(store.read(store.manifest(), "t", "k string, v int").collect()) == want
        assert len(entry["versions"]) <= MOST_VERSIONS


def test_daily_spikes_are_each_days_spikes(spark):
    ev = events(spark, *[(f"s{d}{i}", k, "", d * 86_400 + t) for d in range(2) for i in range(4 + d) for k, t in (("VideoPlay", 600), ("VideoSessionEnd", 2400))])
    ds = Dataset(ev, content(spark), 3000)
    got = insights.daily_spikes(ds, S0, S0 + 2 * 86_400, 2, 10)
    for d in range(2):
        low, high = S0 + d * 86_400, S0 + (d + 1) * 86_400
        one = insights.spike_events(ds, low, high, insights.spike_candidates(ds, low, high, 2, 10))
        assert one.count() == 1 and rows(got.where(F.col("day") == low // 86_400).drop("day")) == rows(one)
