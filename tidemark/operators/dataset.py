"""A dataset: events and a catalogue, and the tables derived from them, each a lazy DataFrame, or stored and read from files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from threading import RLock
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bins import binned
from tidemark.functions.core import div
from tidemark.operators import derive

#: What tables are sorted by within their files, the first of these that they have: windows then skip files and row groups.
TIMES = ("minute", "m", "run_start", "second", "start", "first_active", "ts")


def in_time_order(table: DataFrame, *parts: int) -> DataFrame:
    """Rows dealt to files by ranges of time, so that a window reads few of them. ``parts``: how many ranges, where the session's number won't do."""
    order = [c for c in TIMES if c in table.columns][:1]
    # Many rows can share a time: sessions that were never active all have 0.
    return table.repartitionByRange(*parts, *order, *[c for c in LOOKED_UP if c in table.columns]).sortWithinPartitions(*order, *[c for c in ("platform", "country", "content_id") if c in table.columns]) if order else table


def by_day(table: DataFrame, at: str, *parts: int) -> DataFrame:
    """Rows dealt to files by hours of a day, so that a folder a day has files of a bounded span of time. ``parts`` as in in_time_order."""
    hour = div(F.col(at), {"minute": 60, "m": 60, "second": 3600}[at])
    return table.repartition(*parts, "day", hour).sortWithinPartitions("day", at, "platform", "country", "content_id")


#: The two orders of a layer's rows within a day. Filters on leading columns skip row groups, by their statistics.
ORDERS = (("minute", "platform", "country", "content_id"), ("video_resolution", "audio_language", "subtitle_language", "player_version", "app_version", "minute"))
#: Columns by which runs are looked up one by one.
LOOKED_UP = ("sid", "user_id")


class Layer(NamedTuple):
    """Changes of a count over time, in days, and what was open when each day began: a window needs its own days and one opening.

    ``other``, where there is one, makes the same changes in the second of ``ORDERS``.
    """

    changes: DataFrame
    openings: DataFrame
    per_day: int
    other: Callable[[], DataFrame] | None = None

    def ordered_for(self, filtered: Collection[str]) -> Layer:
        """The layer in the order of which filters on these columns skip more: that with more of them in front."""
        led = [next((k for k, c in enumerate(order) if c not in filtered), len(order)) for order in (ORDERS[0][1:], ORDERS[1])]
        return self._replace(changes=self.other(), other=None) if self.other is not None and led[1] > led[0] else self

    def where(self, condition: Column) -> Layer:
        return Layer(self.changes.where(condition), self.openings.where(condition), self.per_day)

    def semi(self, keys: DataFrame, on: str) -> Layer:
        return Layer(self.changes.join(keys, on, "left_semi"), self.openings.join(keys, on, "left_semi"), self.per_day)

    def within(self, at: str, start: int, end: int) -> DataFrame:
        """Changes at times in [start, end)."""
        days = (F.col("day") >= start // self.per_day) & (F.col("day") <= max(end - 1, start) // self.per_day)
        return self.changes.where(days & (F.col(at) >= start) & (F.col(at) < end)).drop("day")

    def window(self, at: str, start: int, end: int) -> DataFrame:
        """Changes that sum up, from the beginning of start's day on, to the count at any time in [start, end)."""
        day = start // self.per_day
        dims = [c for c in self.openings.columns if c not in ("day", "value")]
        seed = self.openings.where(F.col("day") == day).select(*dims, F.lit(day * self.per_day).cast("long").alias(at), F.col("value").alias("delta"))
        return self.within(at, day * self.per_day, end).select(*dims, at, "delta").unionByName(seed)


def window_of(layer: DataFrame | Layer, at: str, start: int, end: int, filtered: Collection[str] = ()) -> DataFrame:
    """The changes of a layer that a window [start, end) needs, in the order that suits filters on some columns; a plain table of changes is read from its beginning."""
    return layer.ordered_for(filtered).window(at, start, end) if isinstance(layer, Layer) else layer.where(F.col(at) < end)


#: Bytes of event files (some 30,000 to 60,000 events) for which a partition is reckoned, and partitions at most.
PART_BYTES, MOST_PARTS = 1 << 19, 20_000
#: Of how many such partitions a task writes the rows: derived tables are narrower than events, and files should not be small.
PARTS_A_FILE = 4


def side_by_side(calls: Iterable[Callable[[], object]], most: int = 4) -> list:
    """The results of calls, some of which run at a time: jobs of small tables leave cores idle when they wait for each other."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def file_bytes(df: DataFrame) -> int:
    """The size of the files that a table is read from; 0 where there are none."""
    spark = df.sparkSession
    size = 0
    for name in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return size


def partitions(df: DataFrame) -> int:
    """In how many partitions to work on a table: as many as the session's, and more where its files are large, so that a task's share doesn't grow with the input."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(file_bytes(df) // PART_BYTES, MOST_PARTS))


def source_mark(events: DataFrame, content: DataFrame, *rest: object) -> str:
    """A name for what tables are derived from: plans, files with their sizes and times, and parameters. Sources without files never share one."""
    parts = [repr(rest)]
    spark = events.sparkSession
    for df in (events, content):
        # Numbers of columns and plans differ between sessions.
        parts.append(re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]", "", df._jdf.queryExecution().optimizedPlan().toString()))
        files = sorted(df.inputFiles())
        if not files:
            parts.append(str(df.semanticHash()))
        for name in files:
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            state = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
            parts.append(f"{name} {state.getLen()} {state.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


class Dataset:
    """With a ``folder``, every table is written there when it is first asked for and read from there afterwards.

    Tables stand under a name for their source (``source_mark``): other events, catalogues, tolerances or pause rules don't meet them.
    With ``only``, just these tables are written, as they come and in no order: drafts, for who reads each of them as a whole.
    """

    def __init__(self, events: DataFrame, content: DataFrame, tolerance: int, strict: bool = True, folder: str | None = None, only: Collection[str] | None = None):
        self.events, self.content, self.tolerance, self.strict, self.folder, self.only = events, content, tolerance, strict, folder, only
        self._held: dict[str, DataFrame] = {}
        self._making: dict[str, RLock] = {}
        self._place: str | None = None
        self._parts: int | None = None

    @property
    def parts(self) -> int:
        """Partitions in which events are derived."""
        if self._parts is None:
            self._parts = partitions(self.events)
        return self._parts

    @property
    def written(self) -> tuple[int, ...]:
        """Partitions in which derived tables are written; none named where the session's number will do, so that Spark may put small ones together."""
        parts = self.parts // PARTS_A_FILE
        return (parts,) if parts > int(self.events.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()

    @property
    def by_session(self) -> DataFrame:
        """The events, dealt by session once, for all groupings and windows of a session: no table of a whole file's sessions is held where files are read."""
        return self.events.repartition(self.parts, "sid")

    def at_hand(self, name: str) -> bool:
        """Whether a table is held, or written when it is asked for."""
        return name in self._held or bool(self.folder) and (self.only is None or name in self.only)

    def drafts(self, name: str) -> bool:
        """Whether a table is held, or one of those that alone are written."""
        return name in self._held or self.only is not None and name in self.only

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        # Who asks for a table while it is made waits for it.
        with self._making.setdefault(name, RLock()):
            if name not in self._held:
                out = make()
                if self.folder and self.only is not None:
                    if name in self.only:
                        path = f"{self.folder}/{name}"
                        out.write.parquet(path)
                        out = out.sparkSession.read.schema(out.schema).parquet(path)
                elif self.folder:
                    # The writer's commit is the switch: a table that was not written to its end has no _SUCCESS and is written again.
                    path = f"{self.place}/{name}"
                    if not exists(out, f"{path}/_SUCCESS"):
                        if "slot" in out.columns:
                            out.repartition("level", "slot").sortWithinPartitions("level", "slot", "bin").write.mode("overwrite").partitionBy("level", "slot").parquet(path)
                        elif "day" in out.columns:
                            at = next((c for c in ("minute", "m", "second") if c in out.columns), None)
                            if name.endswith("_by_suffix"):
                                # A number of its own: small partitions are not put together, as a file should hold few values.
                                parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                                rows = out.repartition(parts, "day", *ORDERS[1][:2]).sortWithinPartitions("day", *ORDERS[1])
                            else:
                                rows = by_day(out, at, *self.written) if at else out.repartition("day")
                            rows.write.mode("overwrite").partitionBy("day").parquet(path)
                        else:
                            writer = in_time_order(out, *self.written).write.mode("overwrite")
                            for c in LOOKED_UP:
                                if c in out.columns:
                                    writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                            writer.parquet(path)
                    out = out.sparkSession.read.schema(out.schema).parquet(path)
                self._held[name] = out
        return self._held[name]

    @property
    def place(self) -> str:
        """Where a stored dataset's tables stand."""
        if self._place is None:
            self._place = f"{self.folder}/source-{source_mark(self.events, self.content, self.tolerance, self.strict)}"
        return self._place

    @property
    def intervals(self) -> DataFrame:
        return self.table("intervals", lambda: derive.intervals(self.by_session, self.content, self.tolerance, self.strict))

    @property
    def session_runs(self) -> DataFrame:
        # Stored intervals are no longer dealt by session.
        ivs = lambda: self.intervals.repartition(self.parts, "sid") if self.folder else self.intervals
        return self.table("session_runs", lambda: derive.session_runs(ivs()))

    @property
    def user_runs(self) -> DataFrame:
        return self.table("user_runs", lambda: derive.user_runs(self.session_runs.repartition(self.parts, "user_id")))

    @property
    def deltas(self) -> DataFrame:
        return self.table("deltas", lambda: derive.deltas(self.session_runs).withColumn("day", div(F.col("minute"), 1440)))

    @property
    def user_deltas(self) -> DataFrame:
        return self.table("user_deltas", lambda: derive.deltas(self.user_runs).withColumn("day", div(F.col("minute"), 1440)))

    @property
    def boundaries(self) -> DataFrame:
        return self.table("boundaries", lambda: derive.boundary_deltas(self.intervals).withColumn("day", div(F.col("second"), 86_400)))

    @property
    def minutes(self) -> Layer:
        """Sessions by the minute."""
        return Layer(self.deltas, self.table("openings", lambda: derive.openings(self.session_runs, F.col("run_start"), F.col("run_end") + 1, 1440)), 1440, self._other("deltas"))

    def _other(self, name: str) -> Callable[[], DataFrame] | None:
        """A stored layer's copy in the other order, written when a filter first asks for it."""
        return (lambda: self.table(f"{name}_by_suffix", lambda: getattr(self, name))) if self.folder else None

    @property
    def user_minutes(self) -> Layer:
        return Layer(self.user_deltas, self.table("user_openings", lambda: derive.openings(self.user_runs, F.col("run_start"), F.col("run_end") + 1, 1440)), 1440, self._other("user_deltas"))

    @property
    def seconds(self) -> Layer:
        spans = lambda: self.intervals.where("end > start").withColumn("sign", F.lit(1))
        return Layer(self.boundaries, self.table("boundary_openings", lambda: derive.openings(spans(), F.col("start"), F.col("end"), 86_400)), 86_400)

    @property
    def naive(self) -> DataFrame:
        return self.table("naive", lambda: derive.naive_runs(self.by_session, self.content, self.tolerance))

    @property
    def session_index(self) -> DataFrame:
        """Session runs with their bins, for windows that look for what overlaps them."""
        return self.table("session_index", lambda: binned(self.session_runs))

    @property
    def naive_index(self) -> DataFrame:
        return self.table("naive_index", lambda: binned(self.naive))

    def as_of(self, seconds: int) -> Dataset:
        """The dataset as its events up to a time tell it: what came later is as if it never had."""
        return Dataset(self.events.where(F.col("ts") < seconds * 1000), self.content, self.tolerance, self.strict, self.folder)

    def drafted(self, folder: str, only: Collection[str]) -> Dataset:
        """The same dataset with these tables alone written under a folder of their own, which the caller drops."""
        return Dataset(self.events, self.content, self.tolerance, self.strict, folder, only)

    def stored(self, folder: str) -> Dataset:
        """The same dataset with its tables kept under ``folder``; events are stored by session, so that derivation finds them together."""
        return Dataset(self.events, self.content, self.tolerance, self.strict, folder)

    def derive_all(self) -> dict[str, int]:
        """Write all layers of a stored dataset; what must hold afterwards, each 0 (raises where one isn't)."""
        for name in ("intervals", "session_runs", "user_runs", "minutes", "user_minutes", "seconds"):
            getattr(self, name)
        bad = {r["check"]: r["bad"] for r in conditions(self).collect()}
        if any(bad.values()):
            raise ValueError(f"derived layers contradict themselves: {bad}")
        return bad


def exists(of: DataFrame, path: str) -> bool:
    spark = of.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def conditions(ds: Dataset) -> DataFrame:
    """What derived layers must keep to: rows (check, bad), of which every ``bad`` is 0."""
    one = lambda name, df, bad: df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("bad")).select(F.lit(name).alias("check"), "bad")
    ends = ds.events.where("event_type = 'VideoSessionEnd'").groupBy("sid").agg(div(F.max("ts"), 1000).alias("last"))
    out = one("intervals_past_the_last_end", ds.intervals.join(ends, "sid"), F.count_if(F.col("end") > F.col("last")))
    for part in (
        one("intervals_longer_than_the_tolerance", ds.intervals, F.count_if(F.col("end") - F.col("start") > ds.tolerance)),
        one("session_deltas_close", ds.deltas, F.abs(F.sum("delta"))), one("user_deltas_close", ds.user_deltas, F.abs(F.sum("delta"))), one("boundaries_close", ds.boundaries, F.abs(F.sum("delta"))),
        one("runs_end_before_they_start", ds.session_runs, F.count_if(F.col("run_end") < F.col("run_start"))),
        one("minutes_of_runs_and_deltas_differ", ds.session_runs.select((F.col("run_end") + 1 - F.col("run_start")).alias("n")).unionByName(ds.deltas.select((F.col("minute") * F.col("delta")).alias("n"))), F.abs(F.sum("n"))),
        *[one(f"{name}_openings_differ_from_deltas", _unexplained(layer), F.count(F.lit(1))) for name, layer in (("session", ds.minutes), ("user", ds.user_minutes), ("boundary", ds.seconds))],
    ):
        out = out.unionByName(part)
    return out


def _unexplained(layer: Layer) -> DataFrame:
    """Days and dimensions at which an opening and the day's changes don't add up to the next opening."""
    dims = [c for c in layer.openings.columns if c not in ("day", "value")]
    rows = layer.changes.select(*dims, "day", F.col("delta").alias("v")).unionByName(layer.openings.select(*dims, "day", F.col("value").alias("v")))
    return rows.unionByName(layer.openings.select(*dims, (F.col("day") - 1).alias("day"), (-F.col("value")).alias("v"))).groupBy(*dims, "day").agg(F.sum("v").alias("v")).where("v != 0")


def kept(f):
    """A function of a dataset alone, whose result a stored dataset keeps."""

    @wraps(f)
    def table(ds: Dataset) -> DataFrame:
        return ds.table(f.__name__, lambda: f(ds))

    return table


#: A window that holds all of time, in seconds; 0 stands for never.
EVER = (60, 1 << 33)


def kept_by_minute(f):
    """A function of a dataset and a window [from, to) of seconds, with rows of whole minutes ``m``; a stored dataset keeps it for all of time, by the day."""

    @wraps(f)
    def table(ds: Dataset, start: int, end: int) -> DataFrame:
        m, low, high = F.col("m"), start // 60, end // 60
        inside = (m >= low) & (m < high)
        if ds.folder:
            days = F.col("day").between(low // 1440, (high - 1) // 1440)
            return ds.table(f.__name__, lambda: f(ds, *EVER).withColumn("day", div(m, 1440))).where(days & inside).drop("day")
        return ds._held[f.__name__].where(inside) if f.__name__ in ds._held else f(ds, start, end)

    return table
