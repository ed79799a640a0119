"""Tables of one folder as numbered snapshots: what a manifest names is what there is, for all tables at once.

Files are only ever added, under names of their own. A manifest lists the files of every table; it becomes the current
one by a single rename, which fails where somebody else was first. Readers keep to the manifest they began with, and going
back is a new manifest with an old one's lists.

A table is kept by key or by day. By key, a version holds the rows of the keys that it touched, and the keys: rows of a
key count in the newest version that touched it. By day, a day's rows stand in one folder, replaced as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of a table by key that a reader merges at most; a commit that finds more merges them into one.
MOST_VERSIONS = 8


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._fs = self._paths.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests

    def numbers(self) -> list[int]:
        """Of all committed snapshots, the oldest first."""
        at = self._paths.Path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """The tables of a snapshot, the newest unless told otherwise; of none, nothing."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return {"number": 0, "tables": {}}
        stream = self._fs.open(self._paths.Path(f"{self.folder}/manifests/{number:08d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, after: dict, tables: dict) -> dict:
        """Make these tables the snapshot that follows ``after``; raises, and changes nothing, where another one was committed since."""
        made = {"number": after["number"] + 1, "tables": tables}
        self._fs.mkdirs(self._paths.Path(f"{self.folder}/manifests"))
        draft = self._paths.Path(f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(made, sort_keys=True).encode())
        out.close()
        to = self._paths.Path(f"{self.folder}/manifests/{made['number']:08d}")
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise RuntimeError(f"snapshot {made['number']} was committed by somebody else")
        return made

    def roll_back(self, number: int) -> dict:
        """A new snapshot with the tables of an old one."""
        return self.commit(self.manifest(), self.manifest(number)["tables"])

    def clean(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` snapshots, and the folders that none of these names."""
        numbers = self.numbers()
        named = {p for n in numbers[-keep:] for p in _named(self.manifest(n)["tables"])}
        for n in numbers[:-keep]:
            self._fs.delete(self._paths.Path(f"{self.folder}/manifests/{n:08d}"), False)
        data = self._paths.Path(f"{self.folder}/data")
        if self._fs.exists(data):
            for s in self._fs.listStatus(data):
                if f"{self.folder}/data/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)

    # -- tables

    def write(self, name: str, rows: DataFrame, sort: Iterable[str] = ()) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(path)
        return path

    def drop(self, path: str) -> None:
        """Delete files that ``write`` made and no manifest names."""
        self._fs.delete(self._paths.Path(path), True)

    def read(self, manifest: dict, name: str, schema, low: int | None = None, high: int | None = None) -> DataFrame:
        """A table of a snapshot; of one by day, only days in [low, high) where given. ``schema`` serves a table without files too."""
        entry = manifest["tables"].get(name, {})
        if "versions" in entry:
            return self._merged(entry, schema)
        days = {int(d): p for d, p in entry.get("days", {}).items()}
        paths = [p for d, p in sorted(days.items()) if p and (low is None or d >= low) and (high is None or d < high)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, entry: dict, schema) -> DataFrame:
        out = later = None
        for v in reversed(entry["versions"]):
            rows = self.spark.read.schema(schema).parquet(v["rows"])
            keys = self.spark.read.parquet(v["keys"]).select(entry["key"]) if v["keys"] else None
            if later is not None:
                rows = rows.join(later, entry["key"], "left_anti")
            out = rows if out is None else out.unionByName(rows)
            if keys is not None:
                later = keys if later is None else later.unionByName(keys)
        return out

    def upserted(self, manifest: dict, name: str, key: str, rows: DataFrame, keys_path: str | None, sort: Iterable[str] = ()) -> dict:
        """The entry of a table by key after ``rows`` take the place of all that the keys (at ``keys_path``; None: all there are) had."""
        version = {"rows": self.write(name, rows, sort), "keys": keys_path}
        before = manifest["tables"].get(name, {}).get("versions", []) if keys_path else []
        entry = {"key": key, "versions": [*before, version]}
        if len(entry["versions"]) <= MOST_VERSIONS:
            return entry
        return {"key": key, "versions": [{"rows": self.write(name, self._merged(entry, rows.schema), sort), "keys": None}]}

    def replaced(self, manifest: dict, name: str, rows: DataFrame, days: list[int], sort: Iterable[str] = (), dealt: bool = False) -> dict:
        """The entry of a table by day after these days are rewritten: ``rows`` has a column ``day`` with these alone; days without rows go.

        ``dealt``: few partitions have rows of the same day, and are written as they are.
        """
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        (rows if dealt else rows.repartition("day", *[c for c in sort][:1])).sortWithinPartitions("day", *sort).write.partitionBy("day").parquet(path)
        at = self._paths.Path(path)
        made = {s.getPath().getName().removeprefix("day="): f"{path}/{s.getPath().getName()}" for s in self._fs.listStatus(at) if s.getPath().getName().startswith("day=")}
        if extra := {d for d in made if int(d) not in days}:
            raise ValueError(f"{name} has rows of days that were not asked for: {sorted(extra)[:5]}")
        stands = {d: p for d, p in manifest["tables"].get(name, {}).get("days", {}).items() if int(d) not in days}
        return {"days": stands | made}


def _named(tables: dict) -> set[str]:
    """Folders below ``data`` that tables read."""
    out = set()
    for entry in tables.values():
        out |= {p for v in entry.get("versions", []) for p in (v["rows"], v["keys"]) if p}
        out |= {p.rpartition("/")[0] for p in entry.get("days", {}).values()} | set(entry.get("paths", []))
    return out


def day_list(days: DataFrame) -> list[int]:
    """Days of a table with one column, as numbers: as many as there are days."""
    return sorted(r[0] for r in days.distinct().where(F.col(days.columns[0]).isNotNull()).collect())
