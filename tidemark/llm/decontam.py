"""Benchmark decontamination: passages of training documents query a BM25 index of test items.

The index is inverted: every term has its postings in order of item, cut where blocks of ``BLOCK`` items end,
with the largest score in each block and in the whole list. Scores are shares of an item's threshold, so a
passage retrieves an item from 1 on. All passages of a slice of text are evaluated at once, as block-max WAND
does one: the lists of a passage's terms, lowest maximum first, are not opened up to a pivot below which their
maxima can't reach 1, since an item in these alone isn't retrieved; blocks of the opened lists whose bound stays below 1 are
skipped; what is left is bounded by the maxima of its block in all lists, and only blocks whose bound
reaches 1 have their postings scored. Every item at or above its threshold is retrieved. A retrieved item is a
leak when the passage holds enough of the word shingles of both its question and its answer or, of an item
without separate answer, enough of the shingles of the whole item.

Counts of terms cover the whole benchmark. Indexes are built by tasks, each of a part of the items of about
``SHARD_BYTES``; parts of up to ``CARRIED`` bytes in all are broadcast at a time and asked in one reading of
the documents.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, discard, ship, slices, stage, word_hashes, word_spans
from tidemark.llm.toxicity import GAP

#: Items of a block.
BLOCK = 8
#: About how large the index of one part of the items is, and how much of them is broadcast for one reading of the documents.
SHARD_BYTES, CARRIED = 8 << 20, 64 << 20
K1, B = 1.2, 0.75
#: Lists stay closed while their maxima add up to less than this share of the threshold. Any share up to 1 loses nothing;
#: a lower one opens more lists, and its bounds skip more blocks.
CLOSED = 0.2
#: An item is retrieved from this share of the score that its own text gets.
SHARE = 0.7
SHINGLE, OVERLAP = 5, 0.8


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters and digits and anything beyond ASCII, A-Z lower-cased) and how many each row has."""
    low = LOWER[raw]
    starts, ends, counts = word_spans(low, offsets, GAP)
    return word_hashes(low, starts, ends), counts


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's word shingles that the passage holds; a shorter part is one shingle; of an empty one all are held."""
    n = min(SHINGLE, len(part))
    if not n:
        return 1.0
    rows = lambda x: {r.tobytes() for r in np.lib.stride_tricks.sliding_window_view(x, n)} if len(x) >= n else set()
    mine = rows(part)
    return len(mine & rows(passage)) / len(mine)


def least_share(words: np.ndarray, terms: np.ndarray, impact: np.ndarray, least: float) -> float:
    """A lower bound of the score, as a share of the whole, that a passage gets which holds ``least`` of the item's shingles.

    A term is lost only with all shingles that hold it, and a shingle holds up to ``SHINGLE`` terms; the most
    that can be lost within that allowance is bounded by taking the dearest terms for it first, the last in part.
    """
    n = min(SHINGLE, len(words))
    grams = np.unique(np.lib.stride_tricks.sliding_window_view(words, n), axis=0)
    lost = len(grams) - math.ceil(least * len(grams) - 1e-9)
    held = np.array([(grams == t).any(axis=1).sum() for t in terms])
    order = np.argsort(-impact / held)
    room = np.maximum(n * lost - (np.cumsum(held[order]) - held[order]), 0)
    return 1 - float((impact[order] * np.minimum(room / held[order], 1)).sum() / impact.sum())


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, one range after another, and the range each is of."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + starts[of], of


def summed(keys: np.ndarray, values: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below ``upto``) and the sum of the values, which are above 0, of each."""
    if upto <= 1 << 21:
        total = np.bincount(keys, values, minlength=1)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    keys, of = np.unique(keys, return_inverse=True)
    return keys, np.bincount(of, values, minlength=len(keys))


class Index:
    """Postings of items (number, words, words of the question, whether the answer was given apart, terms with tf and df), of ``n`` in all."""

    def __init__(self, items: list[tuple], n: int, mean: float, share: float = SHARE, least: float = OVERLAP):
        self.least = least
        self.nr = [i[0] for i in items]
        self.words = [np.array(i[1], np.int64).view(np.uint64) for i in items]
        self.cut = [i[2] for i in items]
        self.apart = [i[3] for i in items]
        self.blocks = max(-(-len(items) // BLOCK), 1)
        terms, impacts, shares = [], [], []
        for k, (_, _, _, apart, own) in enumerate(items):
            t = np.array([r["term"] for r in own], np.int64).view(np.uint64)
            tf, df = (np.array([r[c] for r in own], np.float64) for c in ("tf", "df"))
            impact = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[k]) / mean))
            # An item without separate answer is retrieved wherever enough of it stands, though its rarest words be lost.
            part = share if apart else min(share, least_share(self.words[k], t, impact, least))
            shares.append(max(part, 1e-3))
            terms.append(t)
            impacts.append(impact / (shares[-1] * impact.sum()))
        self.share = np.array(shares)
        self.longest = max(map(len, self.words), default=1)
        # Every stretch as long as the longest item lies within one passage.
        self.size = max(2 * self.longest, 64)
        self.stride = self.size - self.longest + 1
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(items)), [len(t) for t in terms]) if terms else np.zeros(0, np.int64)
        self.impact = np.concatenate(impacts).astype(np.float32) if terms else np.zeros(0, np.float32)
        by = np.lexsort((self.item, term))
        self.item, self.impact = self.item[by], self.impact[by]
        self.terms, of = np.unique(term[by], return_inverse=True)
        # A list's blocks: which they are, where their postings begin, and their maxima.
        key = of * self.blocks + self.item // BLOCK
        self.start = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.zeros(0, np.int64)
        self.key = key[self.start]
        self.block = self.key % self.blocks
        self.start = np.append(self.start, len(key))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(key) else self.impact
        self.list = np.searchsorted(self.key, np.arange(len(self.terms) + 1) * self.blocks)
        self.highest = np.maximum.reduceat(self.most, self.list[:-1]) if len(key) else self.impact

    def passages(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and end of every passage; words are counted over all rows."""
        n = np.where(counts > 0, np.maximum(-(-(counts - self.size) // self.stride), 0) + 1, 0)
        row = np.repeat(np.arange(len(counts)), n)
        base = np.cumsum(counts) - counts
        first = base[row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        return row, first, np.minimum(first + self.size, base[row] + counts[row])

    def search(self, words: np.ndarray, counts: np.ndarray, skipped: dict[str, int] | None = None):
        """(passage, item, score as a share of the item's own) of all items at or above their thresholds; counts of what was skipped."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms) or not len(words):
            return none
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words)
        term = at[hit]
        _, first, end = self.passages(counts)
        low, high = np.searchsorted(hit, first), np.searchsorted(hit, end)
        # The distinct terms of every passage, those with the lowest maximum first.
        within, of = ranges(low, high)
        pairs = np.unique(of * len(self.terms) + term[within])
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        by = np.lexsort((self.highest[term], passage))
        passage, term = passage[by], term[by]
        begin = np.searchsorted(passage, np.arange(len(first) + 1))
        total = np.concatenate([[0.0], np.cumsum(self.highest[term], dtype=np.float64)])
        enough = 1 - 1e-4
        upto = total[1:] - total[begin[passage]]
        closed = upto < CLOSED
        rest = np.zeros(len(first))
        np.maximum.at(rest, passage[closed], upto[closed])
        open_ = np.flatnonzero(~closed)
        # Blocks of the opened lists.
        where, of = ranges(self.list[term[open_]], self.list[term[open_] + 1])
        keys, bound = summed(passage[open_][of] * self.blocks + self.block[where], self.most[where], len(first) * self.blocks)
        p, b = keys // self.blocks, keys % self.blocks
        maybe = bound + rest[p] >= enough
        p, b = p[maybe], b[maybe]
        # Their maxima in all lists of the passage.
        pair, of = ranges(begin[p], begin[p + 1])
        found = np.searchsorted(self.key, key := term[pair] * self.blocks + b[of])
        known = self.key[np.minimum(found, len(self.key) - 1)] == key
        found, of = found[known], of[known]
        live = np.bincount(of, self.most[found], minlength=len(p)) >= enough
        if skipped is not None:
            for name, n in (("closed", closed.sum()), ("lists", len(term)), ("bounded", len(maybe)), ("refined", len(p)), ("scored", live.sum()), ("all", len(first) * self.blocks)):
                skipped[name] = skipped.get(name, 0) + int(n)
        # Postings of the blocks that are left.
        found, of = found[live[of]], of[live[of]]
        post, which = ranges(self.start[found], self.start[found + 1])
        size = max(len(self.nr), 1)
        keys, score = summed(p[of[which]] * size + self.item[post], self.impact[post], len(first) * size)
        keys, score = keys[score >= enough], score[score >= enough]
        return keys // size, keys % size, score * self.share[keys % size]

    def leaks(self, words: np.ndarray, counts: np.ndarray):
        """(row, item number, share of the item's own score, question overlap, answer overlap, first word): the best passage of every leak."""
        row, first, end = self.passages(counts)
        base = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple] = {}
        for p, k, score in zip(*(x.tolist() for x in self.search(words, counts)), strict=True):
            passage, own = words[first[p] : end[p]], self.words[k]
            q, a = overlap(own[: self.cut[k]], passage), overlap(own[self.cut[k] :], passage)
            if q >= self.least and a >= self.least or not self.apart[k] and overlap(own, passage) >= self.least:
                r, at = int(row[p]), int(first[p] - base[row[p]])
                found = (q + a, score, -at)
                if (r, k) not in best or found > best[r, k][0]:
                    best[r, k] = (found, (r, self.nr[k], round(score, 6), round(q, 6), round(a, 6), at))
        return [best[k][1] for k in sorted(best)]


def _items(batches):
    """Rows (nr, text, answer) to the words of an item: of question and answer, or of one text whose last quarter (three words at least) is its answer."""
    for rows, raw, offsets in slices(batches, "text"):
        answers = rows.column(2).cast(pa.large_binary())
        apart = answers.is_valid().to_pylist()
        words, counts = words_of(raw, offsets)
        flat = np.frombuffer(b"".join(a or b"" for a in answers.to_pylist()), np.uint8)
        more, each = words_of(flat, np.concatenate([[0], np.cumsum([len(a or b"") for a in answers.to_pylist()])]))
        at, also = (np.concatenate([[0], np.cumsum(c)]) for c in (counts, each))
        whole = [np.concatenate([words[at[k] : at[k + 1]], more[also[k] : also[k + 1]]]) for k in range(len(counts))]
        cut = [int(m) if a else max(int(m) - max(3, int(m) // 4), 0) for m, a in zip(counts, apart, strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([w.view(np.int64) for w in whole], pa.list_(pa.int64())), pa.array(cut, pa.int64()), pa.array(apart)], names=["nr", "words", "cut", "apart"])


def _build(n: int, mean: float, share: float, least: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(((r["nr"], r["words"], r["cut"], r["apart"], r["terms"]) for r in table.to_pylist()), key=lambda r: r[0])
        return pa.table({"index": pa.array([pickle.dumps(Index(rows, n, mean, share, least))], pa.binary())})

    return run


def build_indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, share: float = SHARE, least: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nr, id) of all items, numbered in this table, and the pickled indexes (shard, index) of those with a word."""
    spark = benchmark.sparkSession
    ship(spark)
    answer = benchmark[answer_col] if answer_col else F.lit(None).cast("string")
    numbered = stage(benchmark.select(F.monotonically_increasing_id().alias("nr"), benchmark[text_col].alias("text"), answer.alias("answer"), benchmark[item_col].alias("id")), "items")
    items = numbered.select("nr", F.coalesce("text", F.lit("")).alias("text"), "answer").mapInArrow(_items, "nr long, words array<long>, cut long, apart boolean")
    items = stage(items.where(F.size("words") > 0), "item-words")
    terms = items.select("nr", F.explode("words").alias("term")).groupBy("nr", "term").agg(F.count(F.lit(1)).alias("tf"))
    often = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = terms.join(often, "term").groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df"))).alias("terms"))
    n, words = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    # A word costs 8 bytes itself, and a posting, its block's figures and its term up to 48.
    shards = max(-(-56 * words // shard_bytes), 1)
    indexes = items.join(own, "nr").withColumn("shard", F.pmod(F.xxhash64("nr"), F.lit(shards))).groupBy("shard").applyInArrow(_build(n, words / max(n, 1), share, least), "index binary")
    built = stage(indexes.withColumn("shard", F.monotonically_increasing_id()), "indexes")
    discard(items)
    return numbered.select("nr", "id"), built


def carried(indexes: DataFrame, most: int = CARRIED):
    """Lists of indexes, of ``most`` bytes together (or one larger one), one list at a time on the driver."""
    sizes = indexes.select("shard", F.length("index").alias("n")).orderBy("shard").collect()  # two numbers an index
    held, size = [], 0
    groups = []
    for r in sizes:
        if held and size + r["n"] > most:
            groups.append(held)
            held, size = [], 0
        held.append(r["shard"])
        size += r["n"]
    for group in groups + [held] * bool(held):
        yield [pickle.loads(r["index"]) for r in indexes.where(F.col("shard").isin(group)).orderBy("shard").collect()]


def _find(indexes):
    types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())

    def run(batches):
        for rows, raw, offsets in slices(batches, "text"):
            words, counts = words_of(raw, offsets)
            for index in indexes.value:
                found = index.leaks(words, counts)
                if found:
                    row, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=["id", "nr", "score", "question", "answer", "first"])

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    share: float = SHARE, least: float = OVERLAP, shard_bytes: int = SHARD_BYTES, most: int = CARRIED,
) -> DataFrame:
    """One row per document and test item it leaks: id, item_id, score, question_overlap, answer_overlap, first_word.

    score is the passage's BM25 score as a share of what the item's own text gets; first_word is where the
    passage starts; of passages that leak an item alike, the first counts. Without ``answer_col``, or where it is
    null, a passage leaks an item, too, that holds enough of the shingles of its whole text; then one of the two
    overlaps may be small. Null and empty texts leak nothing, and items without a word are not leaked; a document's
    row that is repeated has its leaks repeated; equal items, and rows that repeat an id, each have a row; ids may be
    of any type and null; an empty table on either side gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, nr long, score double, question double, answer double, first long"
    items, indexes = build_indexes(benchmark, item_col, item_text_col, answer_col, share, least, shard_bytes)
    found = spark.createDataFrame([], schema)
    for group in carried(indexes, most):
        found = found.unionByName(rows.mapInArrow(_find(spark.sparkContext.broadcast(group)), schema))
    found = stage(found, "leaks").join(items.withColumnRenamed("id", "item"), "nr")
    return found.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"), F.col("first").alias("first_word"))


def _clean(indexes, text_col: str):
    def run(batches):
        for rows, raw, offsets in slices(batches, text_col):
            words, counts = words_of(raw, offsets)
            bad = np.zeros(rows.num_rows, bool)
            for index in indexes.value:
                bad[[r for r, *_ in index.leaks(words, counts)]] = True
            yield rows.filter(pa.array(~bad))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, shard_bytes: int = SHARD_BYTES, most: int = CARRIED) -> DataFrame:
    """The documents that leak no test item, with all their columns; one reading for every ``most`` bytes of indexes."""
    spark = docs.sparkSession
    ship(spark)
    for group in carried(build_indexes(benchmark, item_col, item_text_col, answer_col, shard_bytes=shard_bytes)[1], most):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(group), text_col), docs.schema)
    return docs
