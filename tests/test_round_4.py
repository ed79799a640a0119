"""What the fourth review found."""

from pyspark.sql import functions as F

from tests.test_operators import T0, content, events
from tests.test_refresh import HISTORY, NEWS, S0, both, rows
from tidemark.operators import insights, refresh
from tidemark.operators.dataset import Dataset


def test_a_refresh_of_what_is_known_commits_nothing(spark, tmp_path):
    """A window that is refreshed again has events, but none that tables were not made of."""
    old, all_ = both(spark)
    names, folder = content(spark), f"file://{tmp_path}"
    refresh.Insights(Dataset(old, names, 90), folder).build()
    new = refresh.Insights(Dataset(all_, names, 90), folder)
    assert new.refresh(S0 + 6000, S0 + 8000)["number"] == 2
    assert new.refresh(S0 + 6000, S0 + 8000)["number"] == 2
    # One more event, equal to one that is known, touches its session alone; another catalogue touches all that are asked for.
    twice = all_.unionByName(all_.where("sid = 'new'"))
    again = refresh.Insights(Dataset(twice, names, 90), folder)
    assert again.refresh(S0 + 6000, S0 + 8000)["number"] == 3
    keys = lambda at: {r["sid"] for r in spark.read.parquet(at.store.manifest()["tables"]["session_facts"]["versions"][-1]["keys"]).collect()}
    assert keys(again) == {"new"}
    other = refresh.Insights(Dataset(twice, content(spark, (1, "b", "live", "c", "s")), 90), folder)
    other.refresh(S0 + 6000, S0 + 8000)
    assert keys(other) == {s for s, *_ in NEWS} and {r["title"] for r in other.read("session_facts").join(spark.createDataFrame([(s,) for s in keys(other)], "sid string"), "sid").collect()} == {"b"}
    assert not [p.name for p in (tmp_path / "data").iterdir() if p.name.startswith(("asked", "steps", "intervals"))]


def test_a_comparison_writes_only_what_several_tables_are_made_of(spark, tmp_path, monkeypatch):
    ev = events(spark, *HISTORY).withColumn("arrival", F.floor(F.col("ts") / 1000).cast("long"))
    at = refresh.Insights(Dataset(ev, content(spark), 90), f"file://{tmp_path}")
    at.build()
    written, drop = [], type(at.store).drop
    monkeypatch.setattr(type(at.store), "drop", lambda self, path: written.extend(p.name for p in (tmp_path / "data" / path.rsplit("/", 1)[1]).iterdir()) or drop(self, path))
    told = at.verify(S0 - 9 * 86_400, S0 + 9 * 86_400).collect()
    assert [r["table"] for r in told] == list(refresh.KEYS) and all(r["only_left"] == r["only_right"] == 0 for r in told)
    assert sorted(written) == sorted(refresh.SHARED)


def test_a_snapshot_shuffles_changes_instead_of_minutes(spark):
    """A session of ten hours is a few rows until its minutes are asked for, and windows cut it anywhere."""
    ev = events(spark, ("s", "VideoPlay", "", -18_000), ("s", "VideoError", "", 18_000), ("s", "VideoError", "", 18_030), ("t", "VideoPlay", "", 60), ("t", "VideoSessionEnd", "", 600))
    ds = Dataset(ev, content(spark), 40_000)
    low, high = T0 // 1000 - 86_400, T0 // 1000 + 86_400
    steps = insights.minute_steps(ds, low, high)
    assert steps.count() <= 8 and steps.agg(F.sum(F.col("next_m") - F.col("m"))).first()[0] == 601
    whole = insights.minute_snapshot(ds, low, high)
    assert whole.agg(F.sum("concurrent_sessions"), F.sum("concurrent_users"), F.sum("video_errors"), F.sum("session_starts")).first()[:] == (609, 609, 2, 2)
    health = insights.playback_health(ds, low, high)
    assert health.agg(F.sum("active_sessions"), F.sum("video_error_sessions")).first()[:] == (609, 1)
    held = Dataset(ev, content(spark), 40_000)
    held._held["minute_steps"] = steps.localCheckpoint()
    for cut in ((low, high), (T0 // 1000 + 300, T0 // 1000 + 900), (T0 // 1000 - 600, T0 // 1000 + 18_000)):
        inside = (F.col("m") >= cut[0] // 60) & (F.col("m") < cut[1] // 60)
        assert rows(insights.minute_snapshot(held, *cut)) == rows(insights.minute_snapshot(ds, *cut)) == rows(whole.where(inside))
        assert rows(insights.playback_health(held, *cut)) == rows(insights.playback_health(ds, *cut)) == rows(health.where(inside))
