"""Intervals of sessions that have settled, appended once and never touched again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import derive
from tidemark.operators.snapshots import Store

#: Seconds without an event after which a session counts as settled.
SETTLE = 86_400


class Settled:
    """An append-only table of intervals, and of the sessions it holds, in a store.

    A run derives the sessions that have been silent for ``settle`` seconds by its clock and that no run before has derived:
    the sessions of all runs before are kept beside their intervals, and probed by an anti join.
    """

    def __init__(self, store: Store, content: DataFrame, tolerance: int, settle: int = SETTLE, strict: bool = True):
        self.store, self.content, self.tolerance, self.settle, self.strict = store, content, tolerance, settle, strict

    def run(self, events: DataFrame, as_of: int) -> dict:
        """Append the intervals of what has settled by ``as_of`` (seconds) among the events up to it; the snapshot after that.

        Sessions of which events came after they were derived are not derived again; ``late`` lists them.
        """
        before, spark = self.store.manifest(), events.sparkSession
        visible = events.where(F.col("ts") <= as_of * 1000)
        silent = visible.groupBy("sid").agg(F.max("ts").alias("last")).where(F.col("last") + self.settle * 1000 <= as_of * 1000)
        fresh = self.store.write("sids", silent.join(self.sessions(spark), "sid", "left_anti"))
        mine = spark.read.parquet(fresh)
        if mine.isEmpty():
            return before
        made = derive.intervals(visible.join(mine.select("sid"), "sid", "left_semi"), self.content, self.tolerance, self.strict)
        tables = dict(before["tables"])
        tables["sessions"] = {"paths": [*tables.get("sessions", {}).get("paths", []), fresh]}
        tables["intervals"] = {"paths": [*tables.get("intervals", {}).get("paths", []), self.store.write("intervals", made, ("start",))]}
        return self.store.commit(before, tables)

    def _paths(self, name: str) -> list[str]:
        return self.store.manifest()["tables"].get(name, {}).get("paths", [])

    def sessions(self, spark) -> DataFrame:
        """Sessions that were derived, and their last event then."""
        paths = self._paths("sessions")
        return spark.read.schema("sid string, last long").parquet(*paths) if paths else spark.createDataFrame([], "sid string, last long")

    def intervals(self, schema) -> DataFrame:
        paths = self._paths("intervals")
        return self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)

    def late(self, events: DataFrame) -> DataFrame:
        """Sessions with events that came, or happened, after they were derived: how many, and the newest."""
        return events.join(self.sessions(events.sparkSession), "sid").where("ts > last").groupBy("sid").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"))
