"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent; their exact counts and
smallest ids are verified, and these winners (at most ``counters / 2`` rows) are broadcast, so their copies
are settled on the map side. Only the digests of small groups are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage

WHITE = r"[\x20\x09-\x0D]+"
COUNTERS = 1024


def _summaries(counters: int):
    """Misra-Gries over a partition: its counters, and one row of what was taken off and what was seen."""

    def run(batches):
        held: dict[bytes, int] = {}
        off = seen = 0
        for batch in batches:
            seen += batch.num_rows
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                cut = int(-np.partition(-np.fromiter(held.values(), np.int64), counters)[counters])
                off += cut
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_pydict(
            {"digest": [*held, None], "cnt": [*held.values(), 0], "off": [0] * len(held) + [off], "seen": [0] * len(held) + [seen]},
            schema=pa.schema([("digest", pa.binary()), ("cnt", pa.int64()), ("off", pa.int64()), ("seen", pa.int64())]),
        )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null text is
    empty. The smallest id of a group stays (null ids come last, and a group of them alone keeps null).
    Rows that repeat an id and a text count each, and stay or go together. An empty table gives an empty
    result. Columns other than the two named are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    text = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), WHITE, " ")
    digests = stage(docs.select(docs[id_col].alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    summary = stage(digests.select("digest").mapInArrow(_summaries(counters), "digest binary, cnt long, off long, seen long"), "summaries")
    total = summary.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("off"), F.lit(0))).first()
    least = max(2, -(-2 * total[0] // counters))
    # True counts are at most the summed counters plus what was taken off, so no frequent digest is missed.
    maybe = summary.where("digest is not null").groupBy("digest").agg(F.sum("cnt").alias("c")).where(F.col("c") + total[1] >= least).select("digest")
    # Counts of at least `least` leave counters / 2 winners at most.
    winners = stage(
        digests.join(F.broadcast(maybe), "digest").groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= least),
        "winners",
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    # Groups are summed up first and joined back, so that a larger one is counted in parts and its rows can be split.
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    groups = stage(rest.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    light = rest.join(groups, "digest")
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
