"""What the corpus operators share: written intermediate tables, and word hashes computed on Arrow buffers.

Intermediate tables are Parquet files under the folder of ``spark.checkpoint.dir``, so that they outlive
any executor. Text is handled as UTF-8 bytes, a couple of megabytes at a time, whatever the batch size is.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows of a batch of text that Spark hands to Python, where the application sets no other number.
BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, or, in local mode, one of our own where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless their Python path has it already.

    Batches of texts are kept short, as executors hold several of them outside the JVM's heap.
    """
    if not spark.sparkContext.getConf().contains(BATCH_SETTING) and int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    top = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "tidemark_llm.zip"
    with zipfile.ZipFile(to, "w") as z:
        for file in [top / "tidemark" / "__init__.py", *(top / "tidemark" / "llm").glob("*.py")]:
            z.write(file, file.relative_to(top))
    spark.sparkContext.addPyFile(str(to))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    # Spark removes the shuffle files of jobs that are over when the driver collects its garbage.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of keys that are broadcast at most: tens of megabytes.
MOST_SENT = 1 << 20


def sent(keys: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """A table of keys for the small side of a join: broadcast where it, or the staged table it is made of row by row, has few rows."""
    return F.broadcast(keys) if (keys if staged is None else staged).count() <= MOST_SENT else keys


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most ``limit`` bytes of text (one row at least): rows, bytes, row offsets. Null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    for batch in batches:
        yield from text_slices(batch, column, limit)


BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64 and of its inverse there."""
    global _powers, _inverse
    if len(_powers) < n:
        m = max(n, SLICE_BYTES + 1)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(m - 1, BASE))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(m - 1, back))])
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values; each salt gives another order."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x632BE59BD9B4E019 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """h with h[i] the polynomial hash of the first i bytes; see span_hash."""
    forward, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends): equal bytes, equal hashes."""
    _, back = powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[ends] - h[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


#: Longer words are hashed one at a time.
LANES = 8


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [starts, ends): eight bytes at a time are mixed in, so that no pattern of bytes makes two words meet.

    Unlike ``span_hash``, a polynomial modulo 2**64, for which some words of 1,024 bytes and more meet whatever its base.
    Words of up to eight bytes meet no other of their length.
    """
    length = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(raw) + 1, 8), (1, 1))
    out = length.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    at = np.flatnonzero((length > 0) & (length <= 8 * LANES))
    for lane in range(LANES):
        at = at[length[at] > 8 * lane]
        if not len(at):
            break
        left = np.minimum(length[at] - 8 * lane, 8)
        bytes_ = eight[starts[at] + 8 * lane].copy().view("<u8").ravel()
        out[at] = mix(out[at] ^ (bytes_ & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))), 7)
    long = np.flatnonzero(length > 8 * LANES)
    if len(long):
        data = raw.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside ``gap``; never across rows), and how many each row has."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gap[raw]
    step = np.diff(inside)
    edges = offsets[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < len(raw))])
    edges = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(edges):
        starts, ends = np.sort(np.concatenate([starts, edges])), np.sort(np.concatenate([ends, edges]))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its n-word shingles, A-Z lower-cased; a shorter row's words as one; none without words."""
    starts, ends, counts = word_spans(raw, offsets)
    words = word_hashes(LOWER[raw], starts, ends)
    at = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams += mix(words[k : k + len(grams)], k + 1)
    grams = mix(grams, 0)
    out = []
    for i, m in enumerate(counts):
        if m >= n:
            out.append(np.unique(grams[at[i] : at[i] + m - n + 1]))
        elif m:
            with np.errstate(over="ignore"):
                whole = sum(mix(words[at[i] + k : at[i] + k + 1], k + 1) for k in range(m))
            out.append(mix(whole, 90 + int(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
