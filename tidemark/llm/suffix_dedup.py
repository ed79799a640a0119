"""Removal of repeated passages by sorting suffixes.

A string of ``length`` bytes is repeated when two suffixes of the corpus agree in their first ``length``
bytes, that is, when they are neighbours in suffix order. Sorting every suffix would move hundreds of times
the corpus, so suffixes that cannot have a partner are ruled out first, exactly:

1. Every window of ``length`` bytes has an anchor, the first of its ``gram``-byte strings with the smallest
   hash. Equal windows have equal anchors at the same place, so consecutive windows of one anchor form a run,
   and only runs whose anchor's string occurs twice go on.
2. Runs that are equal as a whole (anchor and all bytes) are repeated as a whole; one of them stands for all.
3. What is left are the ends of repeated passages. Every ``STEP`` windows of a run, placed from the anchor,
   share an inner stretch of bytes, which must occur in another run for one of them to have a partner; where
   all they cover occurs in another run, all of them have.
4. The suffixes that start at the windows still open are dealt to partitions by ranges of their leading
   tokens (splitters are sampled), sorted there by multikey quicksort, and compared with their neighbours,
   also across partition boundaries. A suffix carries its leading 8-byte tokens and a
   128-bit digest of its first ``length`` bytes as last tokens.

Beside these bytes, the same steps tell which documents share a passage of ``words`` words with another one,
however short its words are. There the tokens are words, and steps 1 and 2 (a run that stands in two documents
settles both of them) leave only the documents that no whole run connects to be judged by their suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, prefix_hash, ship, slices, span_hash, stage, text_slices, word_hashes, word_spans

LENGTH, GRAM, STEP = 400, 100, 16
#: Words of a passage that documents share, and of the grams that anchor it.
WORDS, WORD_GRAM = 50, 8
POSITION = np.uint64((1 << 24) - 1)
BLOCK = 8 << 20
#: Suffixes that one task sorts, about.
RANGE = 500_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    upto = np.minimum.accumulate(y, axis=1).ravel()
    onward = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - w + 1], upto[w - 1 : n])


def runs_of(prefix, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, hash and place of the anchor, hash of the whole) of the runs.

    Rows are parted by ``offsets``; ``prefix(a, b)`` gives the prefix hashes of their units (bytes or words) from a to b.
    """
    spans = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        spans += [(a + i, min(a + i + BLOCK + length - 1, b)) for i in range(0, b - a - length + 1, BLOCK)]
    out = []
    i = 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][1] - spans[i][0] < BLOCK:
            j += 1
        low, high = spans[i][0], spans[j - 1][1]
        h = prefix(low, high)
        at = np.arange(high - low - gram + 1)
        grams = span_hash(h, at, at + gram)
        best = sliding_min((grams & ~POSITION) | at.astype(np.uint64), length - gram + 1)
        windows = np.concatenate([np.arange(a - low, b - low - length + 1) for a, b in spans[i:j]])
        anchor = (best[windows] & POSITION).astype(np.int64)
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(windows) != 1))
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(windows) - 1]])
        start = windows[first] + low
        whole = span_hash(h, windows[first], windows[last] + length).view(np.int64)
        out.append((np.searchsorted(offsets, start, "right") - 1, start, windows[last] + low, grams[anchor[first]].view(np.int64), anchor[first] + low, whole))
        i = j
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def word_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin."""
    starts, ends, counts = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends), np.concatenate([[0], np.cumsum(counts)])


def _runs(length: int, gram: int, words: int, word_gram: int):
    """Rows (id, dig, text) to runs of bytes, which have a digest as ``whole``, and runs of words, which have none."""

    def run(batches):
        for rows, raw, offsets in slices(batches, "text"):
            data = raw.tobytes()
            tokens, at_word = word_tokens(raw, offsets)
            for of_words in (False, True):
                edges = at_word if of_words else offsets
                if of_words:
                    row, first, last, anchor, at, mark = runs_of(lambda a, b: prefix_hash(tokens[a:b]), edges, words, word_gram)  # noqa: B023
                    whole = pa.nulls(len(row), pa.binary())
                else:
                    row, first, last, anchor, at, mark = runs_of(lambda a, b: prefix_hash(raw[a:b]), edges, length, gram)  # noqa: B023
                    whole = pa.array([xxhash.xxh3_128_digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                base = edges[row]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), pa.array(anchor), whole, pa.array(mark), pa.array(at - base), pa.array(first - base), pa.array(last - base)],
                    names=["id", "dig", "anchor", "whole", "mark", "at", "first", "last"],
                )

    return run


def _blocks(length: int, step: int):
    """Rows (id, dig, text, runs) to rows per ``step`` windows of a run: digests of the bytes that all of
    the windows have in common (inner) and that they have together (outer), with the windows' place."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                who, out = [], []
                for k, (text, runs) in enumerate(zip(rows.column(2).cast(pa.large_binary()).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                    for r in runs:
                        # Places are counted from the anchor, so that equal blocks of other runs are cut alike.
                        low = r["first"] - (r["first"] - r["at"]) % step
                        for a in range(low, r["last"] + 1, step):
                            first, last = max(a, r["first"]), min(a + step - 1, r["last"])
                            whole = first == a and last == a + step - 1
                            inner = xxhash.xxh3_128_digest(text[a + step - 1 : a + length])
                            outer = xxhash.xxh3_128_digest(text[a : a + step - 1 + length]) if whole else None
                            who.append(k)
                            out.append((r["anchor"], a - r["at"], inner, outer, first, last, r["n"] == 1))
                if out:
                    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(at), rows.column(1).take(at), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))],
                        names=["id", "dig", "anchor", "off", "inner", "outer", "first", "last", "single"],
                    )

    return run


def _suffixes(length: int):
    """Rows (id, dig, text, runs) to suffixes: two leading tokens, the digest as two more, and where it is."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                texts, wanted = rows.column(2).cast(pa.large_binary()).to_pylist(), rows.column(3).to_pylist()
                for k, (text, runs) in enumerate(zip(texts, wanted, strict=True)):
                    where = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) * 2 + r["single"] for r in runs]))
                    at = where >> 1
                    raw = np.frombuffer(text, np.uint8)
                    lead = [np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[at + s]).view(">u8").ravel().astype(np.uint64) for s in (0, 8)]
                    lead = [(x ^ np.uint64(1 << 63)).view(np.int64) for x in lead]
                    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a : a + length]) for a in at.tolist()), ">i8").astype(np.int64).reshape(-1, 2)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows.column(c)[k].as_py()] * n, rows.column(c).type) for c in (0, 1)]
                        + [pa.array(lead[0]), pa.array(lead[1]), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(at), pa.array((where & 1) == 1)],
                        names=["id", "dig", "t0", "t1", "t2", "t3", "at", "single"],
                    )

    return run


def _word_suffixes(words: int):
    """Rows (id, dig, text, runs) to suffixes of words: two leading tokens, and two of a digest of the passage."""

    def run(batches):
        for batch in batches:
            for rows, raw, offsets in text_slices(batch, "text"):
                tokens, at_word = word_tokens(raw, offsets)
                for k, runs in enumerate(rows.column(3).to_pylist()):
                    at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs]))
                    own = tokens[at_word[k] : at_word[k + 1]]
                    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(own[a : a + words].tobytes()) for a in at.tolist()), ">i8").astype(np.int64).reshape(-1, 2)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows.column(c)[k].as_py()] * n, rows.column(c).type) for c in (0, 1)]
                        + [pa.array(t) for t in (own[at].view(np.int64), own[at + 1].view(np.int64), digest[:, 0].copy(), digest[:, 1].copy())],
                        names=["id", "dig", "t0", "t1", "t2", "t3"],
                    )

    return run


def multikey_quicksort(tokens: list[np.ndarray], few: int = 24) -> np.ndarray:
    """Order of rows by their tokens: parted three ways by a pivot's token, the equal part going on with the next one."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(tokens):
            continue
        part = order[a:b]
        if b - a <= few:
            order[a:b] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        token = tokens[depth][part]
        pivot = np.sort(token[[0, len(token) // 4, len(token) // 2, 3 * len(token) // 4, -1]])[2]
        less, equal = token < pivot, token == pivot
        low, mid = a + int(less.sum()), a + int(less.sum() + equal.sum())
        order[a:b] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        todo += [(a, low, depth), (low, mid, depth + 1), (mid, b, depth)]
    return order


TOKENS = ["t0", "t1", "t2", "t3"]


def _neighbours(batches):
    """Sort a range and compare neighbours: rows whose like is another's (``who``), and the first and last one for the boundaries."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    order = multikey_quicksort([table.column(t).to_numpy() for t in [*TOKENS, "who"]])
    cut = np.zeros(len(order), bool)
    cut[0] = True
    for t in TOKENS:
        cut[1:] |= np.diff(table.column(t).to_numpy()[order]) != 0
    start = np.flatnonzero(cut)
    # Within a stretch of equals rows stand in order of ``who``.
    who = table.column("who").to_numpy()[order]
    matched = (who[start] != who[np.append(start[1:], len(order)) - 1])[np.cumsum(cut) - 1]
    edge = np.zeros(len(order), bool)
    edge[[0, -1]] = True
    single = table.column("single").to_numpy(zero_copy_only=False)[order]
    keep = (matched & single) | edge
    out = table.take(pa.array(order[keep])).append_column("matched", pa.array(matched[keep])).append_column("edge", pa.array(edge[keep]))
    yield from out.to_batches(max_chunksize=50_000)


def matching(suffixes: DataFrame) -> DataFrame:
    """The ``single`` ones of the suffixes (t0, t1, t2, t3, who, single, ...) that equal one of another ``who``."""
    n = suffixes.count()
    parts = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    # Equal suffixes may be many: who they are breaks ties, so they spread over partitions and meet at the boundaries.
    dealt = suffixes.repartitionByRange(parts, *TOKENS, "who")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)
    compared = stage(dealt.mapInArrow(_neighbours, f"{kinds}, matched boolean, edge boolean"), "compared")
    across = compared.where("edge").groupBy(*TOKENS).agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a != b").select(*TOKENS)
    # The edges are two rows a partition; a lone edge matches when another partition ends or starts with it.
    met = compared.where("edge and single and not matched").join(across, TOKENS, "left_semi")
    return compared.where("matched and single").unionByName(met)


def _cut(batches):
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    for batch in batches:
        for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            out = []
            for text, spans in zip(rows.column(1).cast(pa.large_binary()).to_pylist(), rows.column(2).to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), merged))
            yield pa.RecordBatch.from_arrays([rows.column(0)] + [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)] + [rows.column(3)], names=["id", *schema.names, "shares_passage"])


def with_texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, dig, text, runs) of the documents (id, dig) that have any."""
    return docs.alias("d").join(runs.alias("w"), F.expr("d.id <=> w.id and d.dig = w.dig")).select("d.id", "d.dig", F.col("d.text").cast("binary").alias("text"), "w.runs")


def sharing(docs: DataFrame, runs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, dig) of the rows (id, dig, text), whose runs of words are given, that share a passage of ``words`` words with another document.

    Rows that repeat an id and a text are one document.
    """
    kind = docs.schema["id"].dataType.simpleString()
    runs = runs.withColumn("who", F.xxhash64("id", "dig"))
    two = [F.min("who").alias("a"), F.max("who").alias("b")]
    twice = stage(runs.groupBy("anchor").agg(*two).where("a != b").select("anchor"), "word-twice")
    likely = stage(runs.join(twice, "anchor", "left_semi"), "word-likely")
    whole = stage(likely.groupBy("anchor", "mark").agg(*two).where("a != b").select("anchor", "mark"), "word-whole")
    sure = stage(likely.join(whole, ["anchor", "mark"], "left_semi").select("id", "dig", "who").distinct(), "word-sure")
    # What other documents still need: their own runs, and one of each class of runs that have an anchor of theirs.
    left = likely.join(sure.select("who"), "who", "left_anti")
    anchors = stage(left.select("anchor").distinct(), "word-anchors")
    reps = likely.join(anchors, "anchor", "left_semi").groupBy("anchor", "mark").agg(F.min(F.struct("id", "dig", "first", "last")).alias("r"))
    wanted = reps.groupBy("r.id", "r.dig").agg(F.collect_list(F.struct("r.first", "r.last")).alias("runs"))
    suffixes = with_texts(docs, wanted).mapInArrow(_word_suffixes(words), f"id {kind}, dig long, t0 long, t1 long, t2 long, t3 long")
    suffixes = stage(suffixes.withColumns({"who": F.xxhash64("id", "dig"), "single": F.lit(True)}), "word-suffixes")
    found = matching(suffixes)
    out = stage(sure.select("id", "dig").unionByName(found.select("id", "dig")).distinct(), "sharing")
    discard(twice, likely, whole, sure, anchors, suffixes)
    return out


def repeated_spans(docs: DataFrame, runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, dig, spans) of the rows (id, dig, text) that hold repeated strings; spans are [a, b) and may overlap.

    ``runs`` are theirs of bytes; their files are deleted once those that may repeat are found.
    """
    kind = docs.schema["id"].dataType.simpleString()
    # Key tables are written first: both sides of the joins are then plain tables, and hot keys can be split.
    twice = stage(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "twice")
    likely = stage(runs.join(twice, "anchor", "left_semi"), "likely")
    discard(runs)
    place = F.struct("id", "dig", "at", "first", "last")
    classes = stage(likely.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep")), "classes")
    span = [F.col("id"), F.col("dig"), F.col("first").alias("a"), (F.col("last") + length).alias("b")]
    equal = stage(likely.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select(*span), "equal")
    discard(likely)
    # Only runs that are alone have windows left to judge, against all others with their anchor.
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("anchor")
    mixed = stage(mixed, "mixed")
    wanted = (
        classes.join(mixed, "anchor", "left_semi").select("rep.*", "anchor", "n")
        .groupBy("id", "dig").agg(F.collect_list(F.struct("anchor", "at", "first", "last", "n")).alias("runs"))
    )
    texts = stage(with_texts(docs, wanted), "texts")
    discard(classes)
    block = ["anchor", "off", "inner"]
    blocks = stage(texts.mapInArrow(_blocks(length, STEP), f"id {kind}, dig long, anchor long, off long, inner binary, outer binary, first long, last long, single boolean"), "blocks")
    met = stage(blocks.groupBy(*block).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*block), "blocks-twice")
    blocks, before = stage(blocks.join(met, block, "left_semi"), "met"), blocks
    discard(before)
    whole = blocks.where("outer is not null").groupBy(*block, "outer").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "dig", "first", "last")).alias("rep"), F.max("single").alias("single"))
    whole = stage(whole, "whole")
    covered = stage(blocks.where("single").join(whole.where("c > 1").select(*block, "outer"), [*block, "outer"]).select(*span), "covered")
    rest = whole.select(*block, "rep.*", (F.col("single") & (F.col("c") == 1)).alias("single")).unionByName(blocks.where("outer is null").select(*block, "id", "dig", "first", "last", "single"))
    open_ = stage(rest.groupBy(*block).agg(F.count(F.lit(1)).alias("c"), F.max("single").alias("s")).where("c > 1 and s").select(*block), "open")
    left = (
        rest.join(open_, block, "left_semi")
        .groupBy("id", "dig").agg(F.collect_list(F.struct("first", "last", "single")).alias("runs"))
    )
    suffixes = with_texts(texts, left).mapInArrow(_suffixes(length), f"id {kind}, dig long, t0 long, t1 long, t2 long, t3 long, at long, single boolean")
    suffixes = stage(suffixes.withColumn("who", F.xxhash64("id", "dig", "at")), "suffixes")
    discard(texts, blocks, whole)
    windows = matching(suffixes)
    spans = equal.unionByName(covered).unionByName(windows.select("id", "dig", F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    return spans.groupBy("id", "dig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs, as [from, to) in bytes), shares_passage.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any document or the same
    one, is removed; strings are judged on the input and never cross documents. shares_passage is 1 if ``words``
    consecutive words (parted by ASCII white space) also stand in another document, else 0; nothing is removed
    for that alone. Null text is empty; texts shorter than ``length`` keep everything; rows that repeat an id and
    a text are each other's copies where bytes are removed, and one document where passages are shared; an
    empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("dig"), text.alias("text"))
    runs = rows.mapInArrow(_runs(length, gram, words, word_gram), f"id {kind}, dig long, anchor long, whole binary, mark long, at long, first long, last long")
    runs = stage(runs, "runs")
    shared = sharing(rows, runs.where("whole is null").drop("whole", "at"), words)
    spans = repeated_spans(rows, runs.where("whole is not null").drop("mark"), length)
    found = spans.withColumn("shares", F.lit(0)).unionByName(shared.select("id", "dig", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(1).alias("shares")))
    found = found.groupBy("id", "dig").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("shares").alias("shares"))
    joined = rows.alias("d").join(found.alias("s"), F.expr("d.id <=> s.id and d.dig = s.dig"), "left").select("d.id", F.col("d.text").cast("binary").alias("text"), "s.spans", F.coalesce("s.shares", F.lit(0)).alias("shares"))
    return joined.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, shares_passage int").withColumnRenamed("id", id_col)
