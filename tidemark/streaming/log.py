"""Signed logs of a stream: a folder a batch, dealt to buckets within it, and merged into netted segments as batches add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshots import Store

#: Buckets of keys within a batch's folder, unless told otherwise.
BUCKETS = 16
#: Folders of one level that are merged into one of the next.
FAN_IN = 8


class Log:
    """Rows by batch, and within a batch by ``bucket``: a hash of ``key``, or the number that ``by`` gives.

    A batch that runs again replaces its folder. ``compact`` merges batches that are over: eight folders of a level
    become one of the next, in which what was retracted and asserted cancels out (rows keep the sum of their signs), so
    that a reader lists a number of folders that grows with the logarithm of the batches. A manifest names the merged
    folders; what they replace is deleted one merge later, when readers have gone on.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str | None = None, by: Column | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key
        self.by = F.pmod(F.xxhash64(key), F.lit(buckets)) if by is None else by
        self.store = Store(spark, f"{folder}-merged")

    def _batches(self) -> list[int]:
        at = self.store._paths.Path(self.folder)
        if not self.store._fs.exists(at):
            return []
        names = (s.getPath().getName().removeprefix("batch=") for s in self.store._fs.listStatus(at))
        return sorted(int(n) for n in names if n.isdigit())

    def _segments(self) -> list[dict]:
        return self.store.manifest()["tables"].get("log", {}).get("segments", [])

    def folders(self, before: int | None = None) -> list[str]:
        """What holds the batches before a number (all there are)."""
        segments = self._segments()
        upto = max((s["upto"] for s in segments), default=0)
        if before is not None and before < upto:
            raise ValueError(f"batches before {upto} are merged")
        return [s["path"] for s in segments] + [f"{self.folder}/batch={b}" for b in self._batches() if b >= upto and (before is None or b < before)]

    def _read(self, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, batch string, bucket long"
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths).drop("batch") if paths else self.spark.createDataFrame([], schema).drop("batch")

    def buckets(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: as many numbers as there are buckets, at most."""
        return [r["b"] for r in rows.select(self.by.cast("long").alias("b")).distinct().collect()]

    def before(self, batch: int | None, buckets: list[int] | Column | None = None) -> DataFrame:
        """Rows of the batches before this one, of some buckets."""
        log = self._read(self.folders(batch))
        if buckets is not None:
            log = log.where(buckets if isinstance(buckets, Column) else F.col("bucket").isin(buckets))
        return log.drop("bucket")

    def rows(self) -> DataFrame:
        return self.before(None)

    def of(self, batch: int) -> DataFrame:
        return self._read([f"{self.folder}/batch={batch}"] if batch in self._batches() else []).drop("bucket")

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.withColumn("bucket", self.by.cast("long")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch}")

    def drop(self, batch: int) -> None:
        """Delete a batch's folder, which nobody will ask for again."""
        self.store._fs.delete(self.store._paths.Path(f"{self.folder}/batch={batch}"), True)

    def compact(self, upto: int, fan_in: int = FAN_IN) -> None:
        """Merge what is full among the batches before ``upto``, none of which may still be running."""
        manifest = self.store.manifest()
        segments = self._segments()
        merged = max((s["upto"] for s in segments), default=0)
        rows = [{"level": 0, "upto": b + 1, "path": f"{self.folder}/batch={b}"} for b in self._batches() if merged <= b < upto]
        if len(rows) < fan_in:
            return
        all_, gone = [*segments, *rows], []
        level = 0
        while True:
            same = [s for s in all_ if s["level"] == level]
            if len(same) < fan_in:
                break
            log = self._read([s["path"] for s in same])
            if "sign" in log.columns:
                identity = [c for c in log.columns if c != "sign"]
                log = log.groupBy(*identity).agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0")
            path = f"{self.folder}/batch=to-{max(s['upto'] for s in same)}-level-{level + 1}"
            log.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            all_ = [s for s in all_ if s["level"] != level] + [{"level": level + 1, "upto": max(s["upto"] for s in same), "path": path}]
            gone += [s["path"] for s in same]
            level += 1
        left = [s for s in all_ if s["level"] > 0]
        old = manifest["tables"].get("log", {}).get("gone", [])
        self.store.commit(manifest, {"log": {"segments": left, "gone": gone}})
        for path in old:
            self.store._fs.delete(self.store._paths.Path(path), True)
