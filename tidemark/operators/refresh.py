"""Refresh of stored insight tables at the cost of what changed: sessions with new events, their users, and the days they show in.

A session is derived again from all its events whenever one of them is new, however long ago it started and however late
the event is; events are new that the digests kept of every session's events don't know. Tables of sessions and users take
new versions of these keys; tables by the minute are computed again for the days that the sessions showed in, before or now.
All tables change at once, by one manifest, after the gates hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.core import div, netted
from tidemark.operators import derive
from tidemark.operators import insights as i
from tidemark.operators.dataset import Dataset, side_by_side
from tidemark.operators.diff import compared, row_digest
from tidemark.operators.serving import minute_series
from tidemark.operators.snapshots import Store, day_list
from tidemark.vocabulary import INSIGHT_DIMS

#: Seconds before the window in which events still count as new.
LOOK_BACK = 1800
DAY = 86_400
#: The peak and the minutes from which a content's day gets a verdict.
SPIKES = (2, 10)
#: Tables by session, and what they are sorted by.
BY_SESSION = {"session_facts": (i.session_facts, ("session_start",)), "state_transitions": (i.state_transitions, ("ts",)), "session_runs": (lambda ds: ds.session_runs, ("run_start",))}
#: Tables by user, made of facts and runs.
BY_USER = {"content_transitions": (i.content_transitions, ("moved_at",)), "platform_transitions": (i.platform_transitions, ("moved_at",))}
#: Tables by day: how they are made for a window of seconds, the day of a row, and the columns that no two rows share.
BY_DAY = {
    "minute_snapshot": (i.minute_snapshot, lambda: div(F.col("m"), 1440), ["m", *INSIGHT_DIMS]),
    "entry_cohorts": (i.entry_cohorts, lambda: div(F.col("m"), 1440), ["m", *INSIGHT_DIMS]),
    "playback_health": (i.playback_health, lambda: div(F.col("m"), 1440), ["m", *INSIGHT_DIMS]),
    "late_events": (lambda ds, a, b: i.late_events(ds.events.where((F.col("ts") >= a * 1000) & (F.col("ts") < b * 1000))), lambda: F.col("day"), None),
    "spike_events": (lambda ds, a, b: i.daily_spikes(ds, a, b, *SPIKES), lambda: F.col("day"), ["day", "content_id"]),
}


#: Those made of steps row by row, which stand by the day.
OF_STEPS = ("minute_snapshot", "playback_health")

#: Columns by which tables are dealt to buckets when they are compared.
KEYS = {
    "session_facts": ["sid"], "state_transitions": ["sid"], "session_runs": ["sid"], "user_runs": ["user_id"], "content_transitions": ["user_id"], "platform_transitions": ["user_id"],
    "minute_snapshot": ["m"], "entry_cohorts": ["m"], "playback_health": ["m"], "late_events": ["sid"], "spike_events": ["content_id"],
}


#: Tables of which others are made.
SHARED = ("intervals", "session_facts", "session_runs", "user_runs", "minute_steps")
#: By session, what tells whether its events are those that tables were made of.
MARKS = ("n", "a", "b")

_SCHEMAS: dict[tuple[str, str], StructType] = {}


class Insights:
    """Insight tables of a dataset in a store."""

    def __init__(self, ds: Dataset, folder: str):
        self.ds, self.store = Dataset(ds.events, ds.content, ds.tolerance, ds.strict), Store(ds.events.sparkSession, folder)
        self._source = f"{ds.events.schema.json()} {ds.content.schema.json()}"

    def schema(self, name: str):
        """The columns of a table; looked up once for events and catalogues of the same columns, as plans of these tables are long."""
        if name == "session_marks":
            return f"sid {self.ds.events.schema['sid'].dataType.simpleString()}, n long, a decimal(38,0), b decimal(38,0)"
        key = self._source, name
        if key not in _SCHEMAS:
            ds = Dataset(self.ds.events, self.ds.content, self.ds.tolerance, self.ds.strict)
            self._known(name, BY_DAY[name][0](ds, 0, DAY) if name in BY_DAY else ds.user_runs if name == "user_runs" else (BY_SESSION | BY_USER)[name][0](ds))
        return _SCHEMAS[key]

    def _known(self, name: str, rows: DataFrame) -> DataFrame:
        _SCHEMAS.setdefault((self._source, name), rows.drop("day").schema)
        return rows

    def read(self, name: str, start: int | None = None, end: int | None = None, number: int | None = None) -> DataFrame:
        """A table of a snapshot (the newest unless told otherwise); one by day only for the days of the window, in seconds."""
        return self.store.read(self.store.manifest(number), name, self.schema(name), None if start is None else start // DAY, None if end is None else -(-end // DAY))

    def build(self) -> dict:
        """All tables anew, over all of time, as the next snapshot: what stood stays until the very end, and can be returned to."""
        return self._make(None)

    def refresh(self, start: int, end: int, look_back: int = LOOK_BACK) -> dict:
        """The snapshot after events of [start - look_back, end] (seconds), or that arrived in [start, end], are taken in."""
        ts, arrival = F.col("ts"), F.col("arrival")
        return self._make(ts.between((start - look_back) * 1000, end * 1000 + 999) | arrival.between(start, end))

    def verify(self, start: int, end: int, tables: Iterable[str] = ()) -> DataFrame:
        """Tables (all unless named) against ones derived afresh from all events, by digests; tables by day over [start, end), whole days. A row per table, of which the last two columns are 0."""
        out, folder = None, f"{self.store.folder}/data/fresh-{uuid.uuid4().hex}"
        # What several tables are made of is written, and derived once; what is only compared is not.
        fresh = self.ds.drafted(folder, SHARED)

        def one(name: str) -> DataFrame:
            if name in BY_DAY:
                low, high = start // DAY * DAY, -(-end // DAY) * DAY
                have, want = self.read(name, low, high), BY_DAY[name][0](fresh, low, high).drop("day")
            else:
                have, want = self.read(name), fresh.user_runs if name == "user_runs" else (BY_SESSION | BY_USER)[name][0](fresh)
            return compared(name, have, want.select(*have.columns), KEYS[name])

        for row in side_by_side([partial(one, name) for name in tables or KEYS]):
            out = row if out is None else out.unionByName(row)
        self.store.drop(folder)
        return out

    def _make(self, new: Column | None) -> dict:
        ds, store = self.ds, self.store
        before = store.manifest()
        old = lambda name: store.read(before, name, self.schema(name))
        first = new is None or not before["tables"]
        keys: dict[str, str | None] = {"sid": None, "user_id": None}
        events, touched = ds.events, None
        if not first:
            keys["sid"] = self._touched(old, new)
            if keys["sid"] is None:
                return before
            seen = ds.events.sparkSession.read.parquet(keys["sid"])
            touched = seen.select("sid")
            # No event of these sessions is older than this one.
            events = events.where(F.col("ts") >= seen.agg(F.min("low")).first()[0]).join(touched, "sid", "left_semi")
        part = Dataset(events, ds.content, ds.tolerance, ds.strict)
        # Facts and runs are made of the same intervals.
        draft = store.write("intervals", part.intervals)
        part._held["intervals"] = ds.events.sparkSession.read.schema(part.intervals.schema).parquet(draft)
        of_session = {name: partial(self._upserted, before, name, "sid", partial(make, part), keys["sid"], sort) for name, (make, sort) in BY_SESSION.items()}
        of_session["session_marks"] = partial(self._upserted, before, "session_marks", "sid", lambda: (self._marks(ds.by_session) if first else seen).select("sid", *MARKS), keys["sid"])
        tables = dict(zip(of_session, side_by_side(of_session.values()), strict=True))
        now = lambda name: store.read({"tables": tables}, name, self.schema(name))
        both = lambda name, key, by: _both(old(name) if not first else None, now(name), key, by)
        if not first:
            users = both("session_facts", touched, "sid").select("user_id").unionByName(both("session_runs", touched, "sid").select("user_id")).distinct()
            keys["user_id"] = store.write("users", users)
            users = ds.events.sparkSession.read.parquet(keys["user_id"])
        of_users = lambda df: df if first else df.join(users, "user_id", "left_semi")
        people = Dataset(ds.events, ds.content, ds.tolerance, ds.strict)
        people._held["session_facts"] = of_users(now("session_facts"))
        of_user = {name: partial(self._upserted, before, name, "user_id", partial(make, people), keys["user_id"], sort) for name, (make, sort) in BY_USER.items()}
        of_user["user_runs"] = partial(self._upserted, before, "user_runs", "user_id", lambda: derive.user_runs(netted(of_users(now("session_runs")))), keys["user_id"], ("run_start",))
        tables |= dict(zip(of_user, side_by_side(of_user.values()), strict=True))
        # Days that the touched sessions and users show in, as they were or are.
        days = _days(both("session_facts", touched, "sid"), both("session_runs", touched, "sid"), both("user_runs", None if first else users, "user_id"), events)
        store.drop(draft)
        base = {"tables": {}} if new is None else before
        views = [(low * DAY, high * DAY, self._view(now, low * DAY, high * DAY)) for low, high in _ranges(days)]
        steps = [store.write("steps", i.minute_steps(view, low, high)) for low, high, view in views]
        for (_, _, view), path in zip(views, steps, strict=True):
            view._held["minute_steps"] = ds.events.sparkSession.read.parquet(path)
        tables |= dict(zip(BY_DAY, side_by_side([partial(self._replaced, base, t, views, days) for t in BY_DAY]), strict=True))
        for (low, high, view), path in zip(views, steps, strict=True):
            # Whoever asks the view again reads what was written.
            del view._held["minute_steps"]
            view._held["minute_snapshot"] = store.read({"tables": tables}, "minute_snapshot", self.schema("minute_snapshot"), low // DAY, high // DAY)
            store.drop(path)
        # What was written counts only once a manifest names it.
        bad = {}
        for low, high, view in views:
            rows = {t: store.read({"tables": tables}, t, self.schema(t), low // DAY, high // DAY) for t, (_, _, unique) in BY_DAY.items() if unique}
            rows["spike_events"] = rows["spike_events"].withColumn("day", F.to_date("peak_minute"))
            bad |= {k: v for k, v in gates(view, rows, low, high).items() if v}
        if bad:
            raise ValueError(f"refresh refused: {bad}")
        return store.commit(before, tables)

    def _upserted(self, before: dict, name: str, key: str, make: Callable[[], DataFrame], keys: str | None, sort: Iterable[str] = ()) -> dict:
        return self.store.upserted(before, name, key, self._known(name, make()), keys, sort)

    def _replaced(self, before: dict, name: str, views: list[tuple[int, int, Dataset]], days: list[int]) -> dict:
        """The entry of a table by day after it is made again for the views' windows."""
        make, day, _ = BY_DAY[name]
        made = [self._known(name, make(view, low, high)).withColumn("day", day()) for low, high, view in views]
        if not made:
            return before["tables"].get(name, {"days": {}})
        rows = made[0]
        for r in made[1:]:
            rows = rows.unionByName(r)
        return self.store.replaced(before, name, rows, days, ("m",) if "m" in rows.columns else (), name in OF_STEPS)

    def _marks(self, events: DataFrame) -> DataFrame:
        """By session, how many events it has and two digests of them, and of what else tables are made of; ``low`` is its first time."""
        ds = self.ds
        names = ds.content.columns
        digest = lambda columns, salt: F.coalesce(F.sum(row_digest(columns, salt).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        source = f"{ds.tolerance} {ds.strict} {ds.content.agg(F.count(F.lit(1)), digest(names, 2), digest(names, 3)).first()[:]}"
        rows = events.withColumn("_source", F.lit(source))
        columns = sorted(rows.columns)
        return rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), digest(columns, 2).alias("a"), digest(columns, 3).alias("b"), F.min("ts").alias("low"))

    def _touched(self, old, new: Column) -> str | None:
        """Where sessions are written that the condition asks for and whose events are not those that tables were made of, with marks and a time ``low`` before which they have none; None where there are none."""
        ds, store = self.ds, self.store
        asked = store.write("asked", ds.events.where(new).groupBy("sid").agg(F.min("ts").alias("low")))
        seen = ds.events.sparkSession.read.parquet(asked)
        stood = old("session_facts").join(seen, "sid", "left_semi")
        low = seen.agg(F.min("low").alias("x")).unionByName(stood.agg(F.min("session_start").alias("x"))).agg(F.min("x")).first()[0]
        path = None
        if low is not None:
            marks = self._marks(ds.by_session.where(F.col("ts") >= low).join(seen.select("sid"), "sid", "left_semi"))
            moved = marks.join(old("session_marks"), ["sid", *MARKS], "left_anti").join(stood.select("sid", "session_start"), "sid", "left")
            path = store.write("touched", moved.select("sid", *MARKS, F.least("low", "session_start").alias("low")))
            if ds.events.sparkSession.read.parquet(path).isEmpty():
                store.drop(path)
                path = None
        store.drop(asked)
        return path

    def _view(self, now, start: int, end: int) -> Dataset:
        """A dataset whose sessions, users and facts are the stored ones that a window of whole days can show."""
        ds = self.ds
        inside = (F.col("run_start") * 60 < end) & (F.col("run_end") * 60 >= start)
        # A session's minutes lie between its first event and the tolerance after its last one.
        alive = (F.col("session_start") < end * 1000) & (F.greatest("last_event", F.col("last_active") * 1000, "session_end") >= (start - ds.tolerance) * 1000)
        view = Dataset(ds.events.where((F.col("ts") >= start * 1000) & (F.col("ts") < end * 1000)), ds.content, ds.tolerance, ds.strict)
        view._held |= {"session_runs": now("session_runs").where(inside), "user_runs": now("user_runs").where(inside), "session_facts": now("session_facts").where(alive)}
        return view


def _both(old: DataFrame | None, now: DataFrame, keys: DataFrame | None, by: str) -> DataFrame:
    """The rows of some keys as they were and as they are."""
    rows = now if old is None else old.unionByName(now)
    return rows if keys is None else rows.join(keys, by, "left_semi")


def _days(facts: DataFrame, runs: DataFrame, user_runs: DataFrame, events: DataFrame) -> list[int]:
    of_facts = facts.select(F.explode(F.array(*[div(F.col(c), DAY * 1000) for c in ("session_start", "first_play", "session_end")], *[div(F.col(c), DAY) for c in ("first_active", "last_active")])).alias("day")).where("day > 0")
    of_runs = runs.select("run_start", "run_end").unionByName(user_runs.select("run_start", "run_end")).select(F.explode(F.sequence(div(F.col("run_start"), 1440), div(F.col("run_end"), 1440))).alias("day"))
    return day_list(of_facts.distinct().unionByName(of_runs.distinct()).unionByName(events.select(div(F.col("ts"), DAY * 1000).alias("day")).distinct()))


def _ranges(days: list[int]) -> list[tuple[int, int]]:
    """Stretches [low, high) of days that follow each other."""
    out: list[list[int]] = []
    for d in days:
        if out and out[-1][1] == d:
            out[-1][1] = d + 1
        else:
            out.append([d, d + 1])
    return [(a, b) for a, b in out]


def gates(ds: Dataset, made: dict[str, DataFrame], start: int, end: int) -> dict[str, int]:
    """What must be 0 before anything is replaced: keys that several rows share, and minutes whose snapshot differs from the runs' deltas."""
    repeated = lambda t, by: made[t].groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("bad")).select(F.lit(f"{t}_repeats_a_key").alias("gate"), "bad")
    both = made["minute_snapshot"].groupBy(F.col("m").alias("t")).agg(F.sum("concurrent_sessions").alias("c")).join(minute_series(derive.deltas(ds.session_runs), start, end), "t", "full")
    out = both.where(F.coalesce("c", F.lit(0)) != F.coalesce("value", F.lit(0))).agg(F.count(F.lit(1)).alias("bad")).select(F.lit("snapshot_differs_from_deltas").alias("gate"), "bad")
    unique = {t: keys for t, (_, _, keys) in BY_DAY.items() if keys}
    # Equal keys have equal hashes; only where hashes repeat, the keys are looked at.
    for t, keys in unique.items():
        out = out.unionByName(repeated(t, [F.xxhash64(*keys).alias("h")]))
    found = {r["gate"]: r["bad"] for r in out.collect()}
    for t, keys in unique.items():
        if found[f"{t}_repeats_a_key"]:
            found[f"{t}_repeats_a_key"] = repeated(t, keys).first()["bad"]
    return found
