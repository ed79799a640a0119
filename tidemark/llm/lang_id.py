"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 characters, words parted by one space) in order of
frequency. A document's own list is compared to each language's: the distance adds, for every n-gram of the
document, how far its rank is from its rank in the profile, or the profile's length if it isn't there.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage, text_slices

RANKS = 300
#: N-grams that a task counts together before it hands on their sums.
HELD = 1 << 21
#: A document is in none of the languages if its score is below this share of this quantile of what labelled documents
#: get that the profiles were not made from, or below LEAST where there are none.
PART, QUANTILE, LEAST = 0.6, 0.01, 0.05


@functools.cache
def _letters() -> np.ndarray:
    """For the first 65,536 code points: the lower-case letter, or a space. Higher letters count as themselves."""
    out = np.full(1 << 16, 32, np.int64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as numbers, and their counts; none without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    high = points >= 1 << 16
    c = _letters()[np.where(high, 0, points)]
    if high.any():
        c[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
    gap = c == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    c = np.concatenate([[32], c[keep], [32]])
    if len(c) == 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if c[1] == 32:
        c = c[1:]
    if c[-2] == 32:
        c = c[:-1]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(text: str, ranks: int = RANKS) -> np.ndarray:
    """A text's most frequent n-grams, the first the most frequent; ties in order of the n-gram."""
    grams, counts = ngrams(text)
    return grams[np.lexsort((grams, -counts))[:ranks]]


class Profiles:
    def __init__(self, lists: dict[str, list[int]], ranks: int = RANKS):
        self.ranks = ranks
        self.of = []
        for lang in sorted(lists):
            grams = np.array(lists[lang], np.int64)
            by = np.argsort(grams)
            self.of.append((lang, grams[by], by))

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score: one minus the distance as a share of the largest possible one."""
        mine = ranked(text, self.ranks)
        if not len(mine) or not self.of:
            return "und", 0.0
        best = None
        for lang, grams, rank in self.of:
            at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            far = np.where(grams[at] == mine, np.abs(rank[at] - np.arange(len(mine))), self.ranks)
            d = float(far.sum()) / (self.ranks * len(mine))
            if best is None or d < best[1]:
                best = (lang, d)
        return best[0], round(1 - best[1], 6)


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [t or "" for t in rows.column(rows.schema.names.index("text")).to_pylist()]


def _summed(of: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    columns: list[list[pa.Array]] = [[], [], [], []]
    for (lang, out), lists in of.items():
        grams, at = np.unique(np.concatenate([g for g, _ in lists]), return_inverse=True)
        counts = np.zeros(len(grams), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in lists]))
        for column, values in zip(columns, (pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.repeat(pa.scalar(out), len(grams)), pa.array(grams), pa.array(counts)), strict=True):
            column.append(values)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["lang", "out", "gram", "c"])


def _counted(batches):
    """Rows (lang, out, text) to counts of n-grams (lang, out, gram, c), summed over many texts."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        for rows, _, _ in text_slices(batch, "text"):
            for lang, out, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), _texts(rows), strict=True):
                held.setdefault((lang, out), []).append(found := ngrams(text))
                size += len(found[0])
                if size >= HELD:
                    yield _summed(held)
                    held, size = {}, 0
    if held:
        yield _summed(held)


def _learned(known: DataFrame, ranks: int) -> tuple[Profiles, Profiles]:
    """Profiles from labelled rows (lang, out, text): of all of them, and of those that aren't ``out``. Every row is counted."""
    ship(known.sparkSession)
    counts = known.select("lang", "out", "text").mapInArrow(_counted, "lang string, out boolean, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum(F.when(~F.col("out"), F.col("c"))).alias("inner"))
    top = counts
    for c in ("c", "inner"):
        top = top.withColumn(f"rank_{c}", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc_nulls_last(c), "gram")))
    top = stage(top.where((F.col("rank_c") <= ranks) | (F.col("rank_inner") <= ranks)), "profiles")
    lists: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for into, c in zip(lists, ("c", "inner"), strict=True):
        for r in top.where((F.col(f"rank_{c}") <= ranks) & F.col(c).isNotNull()).orderBy("lang", f"rank_{c}").collect():  # `ranks` rows a language
            into.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists[0], ranks), Profiles(lists[1], ranks)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> Profiles:
    """Profiles of the languages of the labelled rows, from all of them."""
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    return _learned(known.select(known[lang_col].alias("lang"), F.lit(False).alias("out"), known[text_col].alias("text")), ranks)[0]


def _predictions(profiles: Profiles):
    def run(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text"):
                out = [profiles.predict(t) for t in _texts(rows)]
                rest = [rows.column(i) for i in range(rows.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1).

    ``und`` with score 0 for a null text, one without a letter, or if no language was learned. Equal distances go
    to the first language by name; repeated rows stay repeated; an empty table gives an empty result; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_predictions(profiles), f"id {kind}, text string, lang_pred string, score double").select(F.col("id").alias(id_col), "lang_pred", "score")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by_col: str = "doc_id", ranks: int = RANKS, part: float = PART, quantile: float = QUANTILE) -> tuple[Profiles, float]:
    """Profiles of the languages of the labelled rows, and the least score of a document in one of them.

    Profiles are made from all labelled rows. For the least score those of three quarters of these score all the
    others; texts without a letter don't count. Quarters are chosen by a hash of ``by_col`` and text.
    """
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    out = F.pmod(F.xxhash64(known[by_col].cast("string"), known[text_col], F.lit("least")), F.lit(4)) == 0
    known = known.select(known[lang_col].alias("lang"), out.alias("out"), known[text_col].alias("text"))
    profiles, inner = _learned(known, ranks)
    rest = known.where(F.col("out") & F.col("lang").isin([lang for lang, *_ in inner.of])).select("lang", "text")
    scored = rest.mapInArrow(_predictions(inner), "lang string, text string, lang_pred string, score double").where("lang_pred != 'und'")
    # Scores have six digits, so that counts of them stay small.
    low = scored.agg(F.percentile("score", F.lit(quantile))).first()[0]
    return profiles, LEAST if low is None else max(LEAST, part * low)


def learn_least(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by_col: str = "doc_id", ranks: int = RANKS, part: float = PART, quantile: float = QUANTILE) -> float:
    """The least score of ``learn``."""
    return learn(docs, text_col, lang_col, by_col, ranks, part, quantile)[1]


def _known(profiles: Profiles, column: str, least: float):
    def run(batches):
        for batch in batches:
            for rows, _, _ in text_slices(batch, column):
                told = [profiles.predict(t or "") for t in rows.column(rows.schema.get_field_index(column)).to_pylist()]
                yield rows.filter(pa.array([lang != "und" and score >= least for lang, score in told], pa.bool_()))

    return run


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents that are in one of the languages: not ``und``, and with a score of ``least`` or more; all their columns, whatever their names."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_known(profiles, text_col, least), docs.schema)


def held_out(id_column, rest: int = 2, of: int = 4):
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % of == rest, F.lit(False))
