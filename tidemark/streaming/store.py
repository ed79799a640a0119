"""Where upkeep keeps its files when the caller names no folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or, in local mode, a temporary one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]
