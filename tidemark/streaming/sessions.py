"""Foreground intervals of a stream of events, with a small state for every session: a batch costs its own events, not the sessions' histories.

Two operators do the same: ``interval_stream`` with Spark's state store and a processor in Python, which is called for
every session and timer, and puts out a stream; ``start``, for many sessions, by joins and windows over whole batches,
with the states as rows of a log.

Events wait until the watermark has passed them, so that a session is followed in order of time however they came. What is
kept of a session is the state it is in, since when, its last end, and its first event's dimensions. An interval is put out
once nothing can change it any more: at the next event, or by a timer when the tolerance is over. After an end only a later
end confirms what is watched in between, so those intervals are kept back until one comes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.core import carried, div, latest
from tidemark.operators.dataset import partitions
from tidemark.operators.derive import catalogue_once, classify
from tidemark.streaming.log import BUCKETS, FAN_IN, Log
from tidemark.vocabulary import DIMS, EVENT_DIMS

WHO = ("user_id", *EVENT_DIMS)
WHO_SCHEMA = ", ".join(f"{c} {'long' if c == 'content_id' else 'string'}" for c in WHO)
OUT = f"sid string, {WHO_SCHEMA}, low long, high long"
#: is_open: the state that the last deciding event left; since: when the point began that the session is at (-1: none, or closed by the tolerance); ended: the last end (-1: none).
STATE = f"is_open int, since long, ended long, {WHO_SCHEMA}"


class Follow(StatefulProcessor):
    """Follows one session. ``tolerance`` in milliseconds."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", f"ts long, c int, ends int, {WHO_SCHEMA}")
        self.unsure = handle.getListState("unsure", "low long, high long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["ts"], r["c"], int(r["event_type"] == "VideoSessionEnd"), *[r[c] for c in WHO]) for r in rows])
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def _advance(self, sid: str, watermark: int) -> Iterator[Row]:
        """Take in the events before the watermark, and close what the tolerance has ended by then."""
        events = list(self.waiting.get())
        ready, later = [e for e in events if e[0] < watermark], [e for e in events if e[0] >= watermark]
        who, found = None, []
        is_open, since, ended = 1, -1, -1
        if self.state.exists():
            is_open, since, ended, *who = self.state.get()
        elif not ready:
            self._wake(later, -1, watermark)
            return
        for ts in sorted({e[0] for e in ready}):
            same = [e for e in ready if e[0] == ts]
            if who is None:
                # Of several at once the smallest by its values, as everywhere.
                who = list(min((e[3:] for e in same), key=lambda w: [(x is not None, x) for x in w]))
            if since >= 0 and is_open:
                found.append((since, min(ts, since + self.tolerance)))
            decided = [e[1] for e in same if e[1] is not None]
            is_open, since = min(decided) if decided else is_open, ts
            if any(e[2] for e in same):
                yield from self._confirm(sid, who, found, ended, ts)
                found, ended = [], ts
        if since >= 0 and since + self.tolerance < watermark:
            if is_open:
                found.append((since, since + self.tolerance))
            since = -1
        if ended < 0:
            yield from self._rows(sid, who, found)
        elif found:
            self.unsure.appendList([f for f in found if f[0] >= ended])
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        self.state.update((is_open, since, ended, *who))
        self._wake(later, since, watermark)

    def _confirm(self, sid: str, who: list, found: list, ended: int, end: int) -> Iterator[Row]:
        """What started before an end, and wasn't put out yet, holds up to it."""
        kept = [*self.unsure.get(), *found] if ended >= 0 else found
        self.unsure.clear()
        yield from self._rows(sid, who, [(a, min(b, end)) for a, b in kept if a < end])

    @staticmethod
    def _rows(sid: str, who: list, spans: list) -> Iterator[Row]:
        for low, high in spans:
            yield Row(sid=sid, **dict(zip(WHO, who, strict=True)), low=low, high=high)

    def _wake(self, later: list, since: int, watermark: int) -> None:
        """One timer: when the next waiting event, or the end of the tolerance, falls before the watermark."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        next_ = [e[0] + 1 for e in later] + ([since + self.tolerance + 1] if since >= 0 else [])
        if next_:
            self.handle.registerTimer(max(min(next_), watermark + 1))

    def close(self) -> None:
        pass


def interval_stream(events: DataFrame, content: DataFrame, tolerance: int, delay: str = "2 hours") -> DataFrame:
    """The stream of intervals of a stream of events, each put out once: columns of ``derive.intervals``.

    Events may come ``delay`` after the newest; what comes later is left out, and counted by Spark's metrics. Repeated events
    change nothing. Needs a state store with timers (RocksDB). Rows come in append mode.
    """
    timed = events.withColumn("c", classify()).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    followed = timed.groupBy("sid").transformWithState(Follow(tolerance * 1000), StructType.fromDDL(OUT), outputMode="append", timeMode="eventTime")
    return _named(followed, content)


def _named(spans: DataFrame, content: DataFrame) -> DataFrame:
    """Spans of milliseconds as ``derive.intervals`` has them."""
    named = spans.join(catalogue_once(content).select("content_id", "video_type"), "content_id", "left")
    return named.select(
        "sid", "user_id", *[F.coalesce("video_type", F.lit("")).alias("video_type") if d == "video_type" else F.col(d) for d in DIMS], div(F.col("low"), 1000).alias("start"), div(F.col("high"), 1000).alias("end"),
    )


#: Where Spark keeps the state that this needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


SPANS = "array<struct<low: long, high: long>>"


def logs(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> dict[str, Log]:
    """What ``start`` keeps: versions of sessions' states, each with the intervals that its batch put out; events that a batch took in or left waiting; its watermark."""
    return {
        "states": Log(spark, f"{folder}/states", f"sid string, version long, {STATE}, unsure {SPANS}, found {SPANS}", "sid", buckets=buckets),
        "events": Log(spark, f"{folder}/events", f"sid string, ts long, c int, ends int, {WHO_SCHEMA}", "sid", buckets=buckets), "clock": Log(spark, f"{folder}/clock", "mark long", by=F.lit(0)),
    }


def start(stream: DataFrame, content: DataFrame, folder: str, tolerance: int, delay: int = 7200, available_now: bool = True, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> StreamingQuery:
    """Follow the sessions of a stream into logs under ``folder``; ``intervals`` reads what was put out.

    ``tolerance`` and ``delay`` are seconds. Events wait until the newest is ``delay`` ahead of them; what comes later than
    that is left out. A batch writes a state for the sessions that it changed, together with what it puts out of them, so
    that one write makes it take effect and a batch that runs again replaces its folder.
    """
    spark = stream.sparkSession
    log = logs(spark, folder, buckets)

    def batch(rows: DataFrame, number: int) -> None:
        was = log["clock"].before(number).agg(F.max("mark")).first()[0]
        was = -(1 << 62) if was is None else was
        new = rows.where(F.col("ts") >= was).select("sid", "ts", classify().alias("c"), (F.col("event_type") == "VideoSessionEnd").cast("int").alias("ends"), *WHO)
        # What the last batch left waiting.
        log["events"].write(number, new.unionByName(log["events"].of(number - 1).where(F.col("ts") >= was)))
        pool = log["events"].of(number)
        newest = pool.agg(F.max("ts")).first()[0]
        mark = was if newest is None else max(was, newest - delay * 1000)
        log["clock"].write(number, spark.range(1).select(F.lit(mark).cast("long").alias("mark")))
        if mark > was:
            log["states"].write(number, _followed(log["states"].before(number), pool.where(F.col("ts") < mark), tolerance * 1000, mark).select("sid", F.lit(number).cast("long").alias("version"), "is_open", "since", "ended", *WHO, "unsure", "found"))
        log["states"].compact(number, fan_in)
        log["clock"].compact(number, fan_in)
        # This batch, which may run again, reads those of the last.
        log["events"].drop(number - 2)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def intervals(spark: SparkSession, folder: str, content: DataFrame) -> DataFrame:
    """Columns of ``derive.intervals``, as far as they were put out under a folder."""
    return _named(logs(spark, folder)["states"].rows().select("sid", *WHO, F.inline("found")), content)


def _followed(states: DataFrame, ripe: DataFrame, tolerance: int, mark: int) -> DataFrame:
    """The states after the events before the watermark ``mark`` of the sessions that these, or the tolerance, change; ``found``: what is put out.

    A session is its points in order of time, the first of them where its state stands.
    """
    parts, who = partitions(ripe), F.struct(*WHO)
    nothing, nobody = F.array().cast(SPANS), F.lit(None)
    held = latest(states.drop("found").repartition(parts, "sid"), ["sid"])
    prior = held.select("sid", F.col("since").alias("ts"), F.col("is_open").alias("c"), F.when(F.col("ended") >= 0, F.col("ended")).alias("ended"), who.alias("who"), "unsure", F.lit(1).alias("prior"))
    # Of several at once the smallest by its values, as everywhere.
    points = ripe.repartition(parts, "sid").groupBy("sid", "ts").agg(F.min("c").alias("c"), F.max("ends").alias("ends"), F.min(who).alias("who"))
    new = points.select("sid", "ts", "c", F.when(F.col("ends") == 1, F.col("ts")).alias("ended"), "who", nobody.cast(SPANS).alias("unsure"), F.lit(0).alias("prior"))
    order = Window.partitionBy("sid").orderBy("ts", F.desc("prior"))
    ts, high = F.col("ts"), F.coalesce(F.least("next_ts", F.col("ts") + tolerance), F.col("ts") + tolerance)
    at = new.unionByName(prior).repartition(parts, "sid").withColumns({"is_open": F.coalesce(carried(F.col("c"), order), F.lit(1)), "next_ts": F.lead("ts").over(order)})
    closed = (F.col("is_open") == 1) & (ts >= 0) & (F.col("next_ts").isNotNull() | (ts + tolerance < mark))
    by = at.groupBy("sid").agg(
        F.min_by("who", F.struct("ts", -F.col("prior"))).alias("who"), F.max_by("is_open", F.struct("ts", -F.col("prior"))).alias("is_open"), F.max("ts").alias("last"), F.coalesce(F.max("ended"), F.lit(-1)).alias("ended"),
        F.min("prior").alias("idle"), F.coalesce(F.max("unsure"), nothing).alias("unsure"), F.collect_list(F.when(closed, F.struct(ts.alias("low"), high.alias("high")))).alias("spans"),
    )
    over = (F.col("last") >= 0) & (F.col("last") + tolerance < mark)
    # After an end only a later end confirms what is watched in between.
    sure, ended, spans = F.col("ended") < 0, F.col("ended"), F.concat("unsure", "spans")
    confirmed = F.transform(F.filter(spans, lambda x: x["low"] < ended), lambda x: F.struct(x["low"].alias("low"), F.least(x["high"], ended).alias("high")))
    return by.where((F.col("idle") == 0) | over).select(
        "sid", "who.*", "is_open", F.when(over, -1).otherwise(F.col("last")).alias("since"), "ended",
        F.when(sure, nothing).otherwise(F.filter(spans, lambda x: x["low"] >= ended)).alias("unsure"), F.when(sure, spans).otherwise(confirmed).alias("found"),
    )
