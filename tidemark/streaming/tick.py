"""Incremental upkeep: sessions touched by new events are derived again, what stood is retracted, what holds now is asserted.

The log of runs only grows; its rows carry a sign. A tick is a pure function of the log, all events so far and
a window, and one write makes it take effect, under the batch's own folder: a batch that runs again after a
failure replaces its folder and reads the log without it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.core import div, netted
from tidemark.operators import derive
from tidemark.operators.dataset import Dataset, partitions
from tidemark.streaming.log import BUCKETS, FAN_IN, Log

#: Seconds by which an event may be ahead of the clock.
SLACK = 300


def retraction(log: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows that cancel whatever the log holds for the touched keys: as many of the opposite sign as are left over."""
    identity = [c for c in log.columns if c != "sign"]
    net = log.repartition(partitions(log), key).join(touched, key, "left_semi").groupBy(*identity).agg(F.sum("sign").alias("s")).where("s != 0")
    return net.select(*identity, F.explode(F.array_repeat(-F.signum("s").cast("int"), F.abs("s").cast("int"))).alias("sign"))


def session_tick(log: DataFrame | None, events: DataFrame, content: DataFrame, tolerance: int, start: int, end: int, strict: bool = True) -> DataFrame:
    """New log rows for the sessions with an event in [start, end] (ms, both included), derived from all their events."""
    # Dealt like the events, so that a join that isn't broadcast takes a bounded share of them in a task.
    touched = events.where(F.col("ts").between(start, end)).select("sid").repartition(partitions(events), "sid").distinct()
    return sessions_tick(log, events, content, tolerance, touched, strict)


def sessions_tick(log: DataFrame | None, events: DataFrame, content: DataFrame, tolerance: int, touched: DataFrame, strict: bool = True) -> DataFrame:
    """New log rows for these sessions."""
    runs = Dataset(events.join(touched, "sid", "left_semi"), content, tolerance, strict).session_runs
    return runs if log is None else runs.unionByName(retraction(log, touched, "sid").select(*runs.columns))


def user_tick(user_log: DataFrame | None, session_log: DataFrame, touched_users: DataFrame) -> DataFrame:
    """New log rows for the touched users, from the session runs that stand."""
    runs = derive.user_runs(netted(session_log.repartition(partitions(session_log), "user_id").join(touched_users, "user_id", "left_semi")))
    return runs if user_log is None else runs.unionByName(retraction(user_log, touched_users, "user_id").select(*runs.columns))


def believable(now_ms: int, slack: int = SLACK):
    """Whether an event doesn't claim to come from the future: it may be ``slack`` seconds ahead, as some clocks run fast."""
    return F.col("ts") <= now_ms + slack * 1000


def runs_schema(key: str) -> str:
    return f"{key}, " + ", ".join(f"{d} {'long' if d == 'content_id' else 'string'}" for d in derive.DIMS) + ", run_start long, run_end long, sign int"


def faults(sessions: DataFrame, touched: DataFrame, fresh: DataFrame, key: str) -> int:
    """How many runs a tick's log rows leave wrong for touched keys: their net signs are neither 0 nor 1, or they are not those derived afresh."""
    identity = [c for c in sessions.columns if c != "sign"]
    held = sessions.repartition(partitions(sessions), key).join(touched, key, "left_semi").select(*identity, "sign", F.lit(0).alias("fresh"))
    both = held.unionByName(fresh.select(*identity, F.lit(0).alias("sign"), F.lit(1).alias("fresh"))).repartition(partitions(sessions), key)
    # Both sides are made once and counted against each other.
    return both.groupBy(*identity).agg(F.sum("sign").alias("n"), F.sum("fresh").alias("f")).where("n not in (0, 1) or n != f").count()


def logs(spark: SparkSession, folder: str, events_schema: str, buckets: int = BUCKETS) -> dict[str, Log]:
    """The logs that a stream keeps under a folder. ``future`` is dealt to the hours from which its events may be believed."""
    due = div(F.col("ts") - SLACK * 1000, 3_600_000)
    return {
        "events": Log(spark, f"{folder}/events", events_schema, "sid", buckets=buckets), "future": Log(spark, f"{folder}/future", events_schema, by=due),
        "runs": Log(spark, f"{folder}/runs", runs_schema("sid string, user_id string"), "sid", buckets=buckets), "runs_by_user": Log(spark, f"{folder}/runs_by_user", runs_schema("sid string, user_id string"), "user_id", buckets=buckets),
        "user_runs": Log(spark, f"{folder}/user_runs", runs_schema("user_id string"), "user_id", buckets=buckets), "clock": Log(spark, f"{folder}/clock", "now long", by=F.lit(0)),
    }


def start(
    stream: DataFrame, content: DataFrame, folder: str, tolerance: int, available_now: bool = True, now_ms: int | Callable[[int], int] | None = None, gate: bool = False, buckets: int = BUCKETS,
    fan_in: int = FAN_IN, after: Callable[[DataFrame, int, int], None] | None = None,
) -> StreamingQuery:
    """Run ticks over a stream of events into logs under ``folder`` (see ``logs``).

    A tick derives the sessions of its own events again, late ones like any other, and then their users. Events from
    the future are set aside and touch nothing, so that one wrong clock can't move anything; every tick takes back those
    that its clock has come to, so that none is lost. ``now_ms``: the clock, or one by the batch's number; it never goes back.
    The events of a batch are stored first, in folders by a hash of the session, and a tick reads only the folders of its
    sessions and users, so that a session can be derived from its whole history without reading everybody's. Logs are
    compacted as batches add up. With ``gate`` a tick compares what its logs hold for the touched sessions with what is
    derived afresh; where they differ it retracts and asserts once more from the logs as they are, and fails if that
    doesn't help, so that the batch runs again. ``after`` is called at a tick's end with all events so far and the
    first and last second of the tick's own; it may run again with the same ones.
    """
    spark = stream.sparkSession
    log = logs(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema), buckets)
    events, future, runs, by_user, users = (log[n] for n in ("events", "future", "runs", "runs_by_user", "user_runs"))

    def tick(batch: DataFrame, number: int) -> None:
        # A row per batch that isn't merged yet.
        was = log["clock"].before(number).agg(F.max("now")).first()[0]
        now = int(time.time() * 1000) if now_ms is None else now_ms(number) if callable(now_ms) else now_ms
        now = max(now, now if was is None else was)
        log["clock"].write(number, spark.range(1).select(F.lit(now).cast("long").alias("now")))
        good, bucket = believable(now), F.col("bucket")
        own = batch.where(good)
        if was is not None:
            # What was set aside before, and could not be believed until now; hours that are over are not read again.
            hours = (bucket >= was // 3_600_000 - 1) & (bucket <= now // 3_600_000)
            own = own.unionByName(future.before(number, hours).where(good & ~believable(was)))
        events.write(number, own)
        future.write(number, batch.where(~good))
        mine = events.of(number)
        low, high = mine.agg(F.min("ts"), F.max("ts")).first()
        if low is not None:
            _derive(number, mine)
        for one in log.values():
            one.compact(number, fan_in)
        if low is not None and after is not None:
            after(events.before(number + 1), low // 1000, high // 1000)

    def _derive(number: int, mine: DataFrame) -> None:
        held = events.buckets(mine)
        seen, before, touched = events.before(number + 1, held), runs.before(number, held), mine.select("sid").distinct()
        made = lambda: sessions_tick(before, seen, content, tolerance, touched).select(*before.columns)
        runs.write(number, made())
        if gate:
            fresh = Dataset(seen.join(touched, "sid", "left_semi"), content, tolerance).session_runs.drop("sign")
            if faults(runs.before(number + 1, held), touched, fresh, "sid"):
                runs.write(number, made())
                if faults(runs.before(number + 1, held), touched, fresh, "sid"):
                    raise RuntimeError(f"batch {number} leaves session runs that differ from a derivation afresh")
        by_user.write(number, runs.of(number))
        people = runs.of(number).select("user_id").distinct()
        lie = users.buckets(people)
        stood = users.before(number, lie)
        users.write(number, user_tick(stood, by_user.before(number + 1, lie), people).select(*stood.columns))

    writer = stream.writeStream.foreachBatch(tick).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()
