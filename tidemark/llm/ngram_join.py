"""Similarity join on sets of word n-grams, by prefix filters under several global orders.

Under any one order of all n-grams, two sets with Jaccard similarity t or more share one of their first
``n - ceil(t n) + 1`` members. So they do under every order, and a pair is verified only if it shares a
prefix member under each of them. N-grams come in the order of levels of how many documents hold them (one
byte a cell of hashes, filled by counting over all documents; any function of the n-gram is an order, so that
cells may be shared), those of one level in the order of salted hashes. What two prefixes don't share up to the
smaller of their ends bounds the similarity, too; so does a quarter of two sets, before whole ones are compared.

Documents with equal sets are one class. In groups of up to ``small`` classes that share a prefix member the
pairs are listed. In a larger group every class is first compared to one of them, which joins a cluster of
near copies in linear work. Groups whose classes are not all connected then are dealt again by two n-grams,
as linked sets share two of a prefix that is longer by one; where that doesn't part them, classes of like size
are compared in blocks, whose tasks return a spanning forest of the links found, never all pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MOST_SENT, discard, mix, sent, shingles, ship, slices, stage
from tidemark.llm.components import components

SMALL = 48
BLOCK = 256
#: N-grams that several documents within a stretch of text hold, counted so often in all; the levels of the most common ones are broadcast, of this many at most.
COMMON, MOST_COMMON = 4, 1 << 21
#: Cells of levels, a byte each, and levels to a doubling of the count.
CELLS, FINE = 1 << 23, 8
#: Bytes of text within which repeats are counted.
STRETCH = 8 << 20
ORDERS = 2
#: A prefix's keys are noted at this many places.
MARKS = 8
#: Groups whose classes are in more open groups than this, on average, are not dealt again by two n-grams.
DENSE = 4


def _print(grams: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    with np.errstate(over="ignore"):
        return np.array([mix(grams, s).sum(dtype=np.uint64) ^ np.uint64(len(grams)) for s in (11, 12)], "<u8").tobytes()


def _classes(n: int):
    """Rows (id, dig, text) to (id, dig, n, fp) and, apart, the n-grams that repeat within a stretch of text, with their counts."""

    def common(sets: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= 2
        m = int(often.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(grams[often].view(np.int64)), pa.array(counts[often])], names=["id", "dig", "n", "fp", "gram", "c"]
        )

    def run(batches):
        held: list[np.ndarray] = []
        size, kind = 0, pa.null()
        for rows, raw, offsets in slices(batches, "text"):
            sets = shingles(raw, offsets, n)
            kind = rows.column(0).type
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())],
                names=["id", "dig", "n", "fp", "gram", "c"],
            )
            held += sets
            size += len(raw)
            if size >= STRETCH:
                yield common(held, kind)
                held, size = [], 0
        if held:
            yield common(held, kind)

    return run


class Orders:
    """Prefixes of sets under the global orders: n-grams by the level of their cell, then by salted hash."""

    def __init__(self, levels: np.ndarray, t: Fraction):
        self.levels, self.t = levels, t

    def prefix(self, grams: np.ndarray, order: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The first members of a set under an order, ``more`` than two linked sets need to share one, and their keys, ascending."""
        size = min(len(grams) - -(-len(grams) * self.t.numerator // self.t.denominator) + 1 + more, len(grams))
        level = self.levels[grams & np.uint64(len(self.levels) - 1)].astype(np.uint64)
        key = (mix(grams, 20 + order) >> np.uint64(8)) | (level << np.uint64(56))
        first = np.argpartition(key, size - 1)[:size] if size < len(key) else np.arange(len(key))
        first = first[np.argsort(key[first])]
        return grams[first], key[first]


def _rows(o: int, full: list[tuple[bytes, np.ndarray]], orders: Orders):
    """Rows (o, gram, fp, n, marks) of the prefixes of some sets under one order, and a row with ``-1 - o`` for each set.

    The latter hold the prefix's length as ``n`` and its keys at every ``1 / MARKS`` of it as ``marks``.
    """
    fps, sizes = pa.array([f for f, _ in full], pa.binary()), np.array([len(s) for _, s in full])
    first = [orders.prefix(s, o) for _, s in full]
    each = np.array([len(p) for p, _ in first])
    names = ["o", "gram", "fp", "n", "marks"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(each.sum(), o, np.int8)), pa.array(np.concatenate([p for p, _ in first]).view(np.int64)), fps.take(pa.array(np.repeat(np.arange(len(full)), each))), pa.array(np.repeat(sizes, each)), pa.nulls(int(each.sum()), pa.binary())],
        names=names,
    )
    marks = [keys[-(-len(keys) * np.arange(1, MARKS + 1) // MARKS) - 1].astype(">u8").tobytes() for _, keys in first]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), -1 - o, np.int8)), pa.array([int.from_bytes(f[:8], "little", signed=True) for f, _ in full]), fps, pa.array(each), pa.array(marks, pa.binary())], names=names
    )


def _prefixes(n: int, orders: Orders):
    """The first order's prefixes, from texts."""

    def run(batches):
        seen: set[bytes] = set()
        for _, raw, offsets in slices(batches, "text"):
            # Of equal sets in one partition one row goes on; groups of copies thin out before the shuffle.
            full = [(f, s) for s in shingles(raw, offsets, n) if len(s) and (f := _print(s)) not in seen and not seen.add(f)]
            if full:
                yield from _rows(0, full, orders)

    return run


def _more_prefixes(orders: Orders):
    """The further orders' prefixes, from the stored sets of the documents that are left."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                full = [(f, unpack(g).view(np.uint64)) for f, g in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
                for o in range(1, ORDERS):
                    yield from _rows(o, full, orders)

    return run


def _composites(orders: Orders):
    """Rows (fp, grams, open) to rows as of _rows whose n-gram stands for two: one of ``open`` and another of the longer prefix."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                keys, at, size = [], [], []
                for k, (g, of) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                    grams = unpack(g).view(np.uint64)
                    first = orders.prefix(grams, 0, 1)[0]
                    for one in np.array(of, np.int64).view(np.uint64):
                        other = first[first != one]
                        keys.append(mix(np.maximum(other, one), 31) ^ mix(np.minimum(other, one), 32))
                        at.append(np.full(len(other), k))
                        size.append(np.full(len(other), len(grams)))
                n = sum(map(len, keys))
                if n:
                    keys, at, size = (np.concatenate(x) for x in (keys, at, size))
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(keys.view(np.int64)), rows.column(0).take(pa.array(at)), pa.array(size), pa.nulls(n, pa.binary())], names=["o", "gram", "fp", "n", "marks"])

    return run


def _groups(t: Fraction, small: int):
    """Sorted rows of _rows to pairs within small groups (a, b and their sizes), the members of larger ones (a alone), and the rows of single sets as they are."""
    schema = pa.schema([("o", pa.int8()), ("gram", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("na", pa.int64()), ("nb", pa.int64()), ("marks", pa.binary())])

    def run(batches):
        out: list[tuple] = []
        key, members, large = None, {}, False

        def close():
            if not large:
                items = sorted(members.items())
                for i, (a, n) in enumerate(items):
                    for b, m in items[i + 1 :]:
                        if min(n, m) * t.denominator >= max(n, m) * t.numerator:
                            out.append((*key, a, b, n, m, None))

        for batch in batches:
            o = batch.column(0).to_numpy()
            alone = int(np.searchsorted(o, 0))
            if alone:
                b = batch.slice(0, alone)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.nulls(alone, pa.binary()), b.column(3), pa.nulls(alone, pa.int64()), b.column(4)], schema=schema)
                batch, o = batch.slice(alone), o[alone:]
            if not len(o):
                continue
            gram = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(o) != 0)]))
            sizes = np.diff(np.append(cuts, len(o)))
            # Only the first and last group of a batch can go on elsewhere; other groups of one are done.
            for c in np.flatnonzero((sizes > 1) | (np.arange(len(cuts)) == 0) | (np.arange(len(cuts)) == len(cuts) - 1)):
                at, m = int(cuts[c]), int(sizes[c])
                if (now := (int(o[at]), int(gram[at]))) != key:
                    close()
                    key, members, large = now, {}, False
                for fp, size in zip(batch.column(2).slice(at, m).to_pylist(), batch.column(3).slice(at, m).to_pylist(), strict=True):
                    if large:
                        out.append((*key, fp, *[None] * 4))
                    else:
                        members[fp] = size
                        if len(members) > small:
                            large = True
                            out.extend((*key, f, *[None] * 4) for f in members)
                            members = {}
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _sets(n: int):
    def run(batches):
        for rows, raw, offsets in slices(batches, "text"):
            sets = shingles(raw, offsets, n)
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.binary()), pa.array([pack(s) for s in sets], pa.binary())], names=["fp", "grams"])

    return run


def linked(common: int, n: int, m: int, t: Fraction) -> bool:
    return common * t.denominator >= t.numerator * (n + m - common)


def may_link(apart, both, t: Fraction):
    """Whether sets may be linked of which so many members are known to be in one alone, and that have so many together; of numbers or columns."""
    return apart * (t.numerator + t.denominator) <= both * (t.denominator - t.numerator)


def _quarters(batches):
    """Rows (fp, grams) to (fp, size, quarter): the n-grams below a quarter of all hashes, which sorted sets have in front."""
    for batch in batches:
        sets = [unpack(g).view(np.uint64) for g in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack(s[: np.searchsorted(s, np.uint64(1 << 62))]) for s in sets], pa.binary())], names=["fp", "size", "quarter"]
        )


def _sift(t: Fraction):
    """Pairs (a, b, both, x, y) whose quarters x and y don't tell them apart."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep = []
                for both, x, y in zip(rows.column(2).to_pylist(), rows.column(3), rows.column(4), strict=True):
                    x, y = unpack(x.as_py()), unpack(y.as_py())
                    keep.append(may_link(len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)), both, t))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(keep)), rows.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _verify(t: Fraction):
    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep = []
                for x, y in zip(rows.column(2), rows.column(3), strict=True):
                    x, y = unpack(x.as_py()), unpack(y.as_py())
                    keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(keep)), rows.column(1).filter(pa.array(keep))], names=["u", "v"])

    return run


def _block(t: Fraction):
    """One block of a large group: all its sets against each other, as a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fps = table.column("fp").to_pylist()
        sets = [unpack(s) for s in table.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        edges: list[tuple[bytes, bytes]] = []
        if len(sets) > 1:
            grams, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            shared = np.cumsum(counts > 1) - 1
            more = counts[ids] > 1
            ids, owner = shared[ids[more]], owner[more]
            common = np.zeros((len(sets), len(sets)), np.float32)
            by = np.argsort(ids, kind="stable")
            ids, owner = ids[by], owner[by]
            for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
                a, b = np.searchsorted(ids, [low, low + 4096])
                part = np.zeros((len(sets), 4096), np.float32)
                part[owner[a:b], ids[a:b] - low] = 1
                common += part @ part.T
            both = common.astype(np.int64)
            link = both * t.denominator >= t.numerator * (sizes[:, None] + sizes[None, :] - both)
            seen = np.zeros(len(sets), bool)
            for root in range(len(sets)):
                if seen[root]:
                    continue
                seen[root] = True
                todo = [root]
                while todo:
                    x = todo.pop()
                    for y in np.flatnonzero(link[x] & ~seen):
                        seen[y] = True
                        edges.append((fps[x], fps[y]))
                        todo.append(int(y))
        return pa.table({"u": pa.array([a for a, _ in edges], pa.binary()), "v": pa.array([b for _, b in edges], pa.binary())})

    return run


def _merged(groups: DataFrame, block: int) -> DataFrame:
    """Groups (gram, fp) that share classes as one group, where this leaves fewer rows to deal than the groups apart.

    Near copies share most of their n-grams, so that groups of these hold the same classes: merged, a pair meets once.
    """
    cost = lambda n: n * F.ceil(n / block)
    first = stage(groups.groupBy("gram").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")), "block-groups")
    roots = components(groups.join(first, "gram").select("u", F.col("fp").alias("v")))
    # A root is a class of every group that it stands for; a group of one class has no pairs.
    of = first.join(roots, F.col("u") == F.col("node")).select("gram", "n", "root")
    whole = roots.groupBy("root").agg(F.count(F.lit(1)).alias("all"))
    apart = of.groupBy("root").agg(F.sum(cost(F.col("n"))).alias("apart")).join(whole, "root").where(cost(F.col("all")) < F.col("apart"))
    key = of.join(apart, "root").select("gram", F.xxhash64("root").alias("key"))
    return groups.join(key, "gram", "left").select(F.coalesce("key", "gram").alias("gram"), "fp").distinct()


def _levels(often: DataFrame) -> np.ndarray:
    """The cells of the levels of n-grams (gram, level), of the highest levels that MOST_COMMON n-grams have; of n-grams that share a cell the highest one."""
    # A row a level.
    least, n = 256, 0
    for level, c in sorted(map(tuple, often.groupBy("level").count().collect()), reverse=True):
        n += c
        if n > MOST_COMMON:
            break
        least = level
    cells = often.where(F.col("level") >= least).select(F.col("gram").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"), F.col("level").cast("short").alias("level")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    np.maximum.at(out, cells.column("cell").to_numpy(), cells.column("level").to_numpy().astype(np.uint8))
    return out


def _in_rounds(rows: DataFrame, by: list[str], n: int, make, name: str) -> DataFrame:
    """What ``make`` makes of rows, in rounds of about n rows with the same values of ``by`` together, so that what is shuffled stays within what a round ships."""
    rounds = max(-(-rows.count() // n), 1)
    out = None
    for k in range(rounds):
        found = stage(make(rows.where(F.pmod(F.xxhash64(*by), F.lit(rounds)) == k) if rounds > 1 else rows), name)
        out = found if out is None else out.unionByName(found)
    return out


def _chosen(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Rows (id, dig, ...) of these keys. Texts are read once more for every so many keys, rather than shuffled."""
    n = -(-keys.count() // most)
    out = None
    for k in range(max(n, 1)):
        some = keys.where(F.pmod(F.xxhash64("id", "dig"), F.lit(n)) == k) if n > 1 else keys
        found = rows.alias("d").join(F.broadcast(some).alias("r"), F.expr("d.id <=> r.id and d.dig = r.dig"), "left_semi")
        out = found if out is None else out.unionByName(found)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, t: Fraction = Fraction(9, 10), small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable over links, itself included).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than n words is one
    n-gram, an empty or null one has none and is linked with nothing. Documents link when the Jaccard
    similarity of their sets is t or more. Rows that repeat an id each count as documents (null ids come after
    all others); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("dig"), text.alias("text"))
    seen = stage(rows.mapInArrow(_classes(n), f"id {kind}, dig long, n long, fp binary, gram long, c long"), "shingled")
    nodes = seen.where("n is not null")
    often = seen.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    orders = Orders(_levels(stage(often.select("gram", F.least(F.floor(F.log2("c") * FINE), F.lit(255)).cast("int").alias("level")), "often")), t)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def candidates(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs left by the orders of these prefixes (o, a, b, c), and the members of larger groups (o, gram, fp)."""
        dealt = prefixes.repartition(parts, "o", "gram").sortWithinPartitions("o", "gram")
        groups = stage(dealt.mapInArrow(_groups(t, small), "o tinyint, gram long, a binary, b binary, na long, nb long, marks binary"), "groups")
        large = stage(groups.where("b is null and o >= 0").select("o", "gram", F.col("a").alias("fp")).distinct(), "large")
        held = large.select("o", "fp", F.lit(True).alias("in")).distinct()
        shared = groups.where("b is not null").groupBy("o", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        info = groups.where("o < 0").groupBy((-1 - F.col("o")).cast("tinyint").alias("o"), F.col("a").alias("fp")).agg(F.max("na").alias("p"), F.max("marks").alias("q"))
        info = stage(info.join(held, ["o", "fp"], "left"), "prefix-marks")
        for k in ("a", "b"):
            shared = shared.join(info.select("o", F.col("fp").alias(k), F.col("p").alias(f"p{k}"), F.col("q").alias(f"q{k}"), F.col("in").alias(f"in_{k}")), ["o", k])
        # Up to the smaller of the prefixes' last keys both sets are known, at least to within a mark: what isn't shared
        # there tells them apart. N-grams of larger groups aren't counted here, so documents with one are spared this test.
        key = lambda k, i: F.substring(f"q{k}", 8 * i + 1, 8)
        last = F.least(key("a", MARKS - 1), key("b", MARKS - 1))
        upto = [sum(F.when(key(k, i) <= last, 1).otherwise(0) for i in range(MARKS)) for k in ("a", "b")]
        known = [F.ceil(F.col(f"p{k}") * u / MARKS) for k, u in zip(("a", "b"), upto, strict=True)]
        apart = known[0] + known[1] - 2 * F.col("c")
        left = stage(shared.where(F.col("in_a").isNotNull() | F.col("in_b").isNotNull() | may_link(apart, F.col("na") + F.col("nb"), t)).select("o", "a", "b", "c"), "candidates")
        discard(groups)
        return left, large

    def named(roots: DataFrame) -> DataFrame:
        """The result, by the components of classes that links connect."""
        classes = nodes.groupBy("fp").agg(F.min("id").alias("least")).where("fp is not null").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        of = classes.join(classes.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
        alone = nodes.where("fp is null").select("id", "n", F.col("id").alias("component"))
        full = nodes.where("fp is not null").join(of, "fp").select("id", "n", "component")
        return full.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))

    pairs, large = candidates(rows.mapInArrow(_prefixes(n, orders), "o tinyint, gram long, fp binary, n long, marks binary"))
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(large.select("fp")).distinct()
    reps = stage(nodes.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("id", "dig")).alias("r")).select("r.*"), "representatives")
    sets = stage(_chosen(rows, reps, MOST_SENT).mapInArrow(_sets(n), "fp binary, grams binary"), "sets")
    more, larger = candidates(sets.mapInArrow(_more_prefixes(orders), "o tinyint, gram long, fp binary, n long, marks binary"))
    pairs, large = pairs.unionByName(more), large.unionByName(larger)
    inside = large.select("o", "fp").distinct()
    # A pair counts for an order when it is left there or both are in larger groups there.
    held = pairs.groupBy("a", "b").agg(F.collect_set("o").alias("os"), F.max("c").alias("c"))
    for o in range(ORDERS):
        here = inside.where(F.col("o") == o).select("fp")
        ok = held.where(F.array_contains("os", F.lit(o).cast("tinyint")))
        other = held.where(~F.array_contains("os", F.lit(o).cast("tinyint")))
        other = other.join(here.withColumnRenamed("fp", "a"), "a", "left_semi").join(here.withColumnRenamed("fp", "b"), "b", "left_semi")
        held = ok.unionByName(other.select(*ok.columns))
    pairs = stage(held.select("a", "b", "c"), "pairs")
    first = large.where("o = 0").select("gram", "fp")
    for o in range(1, ORDERS):
        first = first.join(inside.where(F.col("o") == o).select("fp"), "fp", "left_semi")
    first = stage(first, "large")
    # Documents that pairs connect, up to a block of them, come together once, rather than once for every pair.
    clusters = stage(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), "clusters")
    sized = clusters.join(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("c")), "root")
    together = sent(sized.where(F.col("c") <= block).select("root", F.col("node").alias("fp")), clusters).join(sets, "fp").groupBy("root").applyInArrow(_block(t), "u binary, v binary")
    links = stage(together, "cluster-links")
    wide = sized.where(F.col("c") > block).select(F.col("node").alias("fp"))
    wide = stage(wide.unionByName(first.select("fp")).distinct(), "wide")
    few = stage(sets.join(sent(wide), "fp", "left_semi"), "few-sets")
    discard(sets)
    sets = few
    pairs, every = stage(pairs.join(sized.where(F.col("c") > block).select(F.col("node").alias("a")), "a", "left_semi"), "wide-pairs"), pairs
    discard(every)
    n_sets = max(sets.count(), 1)
    quarters = stage(sets.mapInArrow(_quarters, "fp binary, size long, quarter binary"), "quarters")

    def both(some: DataFrame, of: DataFrame, column: str) -> DataFrame:
        """Pairs with a column of either set as ``x`` and ``y``."""
        named = lambda k, v: of.select(F.col("fp").alias(k), F.col(column).alias(v), *[F.col(c).alias(f"{c}_{k}") for c in of.columns if c not in ("fp", column)])
        return some.join(named("a", "x"), "a").join(named("b", "y"), "b")

    def verified(some: DataFrame, name: str) -> DataFrame:
        """The links among some pairs, most of which a quarter of the sets tells apart; in rounds that ship about as much as all the sets."""
        sift = lambda now: both(now, quarters, "quarter").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("both"), "x", "y").mapInArrow(_sift(t), "a binary, b binary")
        some = _in_rounds(some, ["a", "b"], 2 * n_sets, sift, f"{name}-near")
        keys = stage(some.select(F.col("a").alias("fp")).unionByName(some.select(F.col("b").alias("fp"))).distinct(), f"{name}-ends")
        of = sets.join(sent(keys), "fp", "left_semi")
        # Rows that repeat an id and a text repeat a set, and so a link; that does no harm.
        return _in_rounds(some, ["a", "b"], n_sets, lambda now: both(now, of, "grams").select("a", "b", "x", "y").mapInArrow(_verify(t), "u binary, v binary"), name)

    if not pairs.isEmpty():
        # In larger clusters first every document's likeliest partner; pairs that these links connect need no look of their own.
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
        likely = verified(best, "best")
        roots = stage(components(likely), "roots")
        ends = [roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b")]
        rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        rest = stage(rest.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b"), "rest")
        links = stage(links.unionByName(likely).unionByName(verified(rest, "rest-links")), "pair-links")
    if first.isEmpty():
        return named(components(links))
    # Larger groups: every class against the least one of its group, then only groups that this leaves in parts.
    least = stage(first.groupBy("gram").agg(F.min("fp").alias("a")), "leaders")
    led = stage(first.join(least, "gram").where("a != fp").select("a", F.col("fp").alias("b")).distinct(), "led")
    links = stage(links.unionByName(verified(led, "leader-links")), "links")
    roots = stage(components(links), "roots")
    member = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stage(member, "members")
    parted = stage(member.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("gram"), "parted")
    member = stage(member.join(parted, "gram", "left_semi"), "open-members")
    if member.isEmpty():
        return named(roots)
    # A window holds the large groups of one class: as many as its prefix has n-grams.
    per = member.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("fp")))
    dense = per.groupBy("gram").agg((F.sum("k") > DENSE * F.count(F.lit(1))).alias("dense"))
    # Two linked sets share two n-grams only above a half.
    member = stage(member.join(dense, "gram").withColumn("dense", F.col("dense") | F.lit(2 * t <= 1)), "dense-members")
    again = member.where("not dense").groupBy("fp").agg(F.collect_list("gram").alias("open")).join(sets, "fp").select("fp", "grams", "open")
    two = again.mapInArrow(_composites(orders), "o tinyint, gram long, fp binary, n long, marks binary")
    groups = two.repartition(parts, "o", "gram").sortWithinPartitions("o", "gram").mapInArrow(_groups(t, small), "o tinyint, gram long, a binary, b binary, na long, nb long, marks binary")
    groups = stage(groups, "two-groups")
    ends = [roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b")]
    near = groups.where("b is not null").select("a", "b").distinct().join(ends[0], "a", "left").join(ends[1], "b", "left")
    near = stage(near.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b"), "two-pairs")
    links = links.unionByName(verified(near, "two-links"))
    wide = stage(member.where("dense").select("gram", "fp").unionByName(groups.where("b is null").select("gram", F.col("a").alias("fp"))).distinct(), "blocked")
    wide = _merged(wide, block)
    # Blocks of classes of like size, which linked ones have: each class meets those of every block once.
    step = F.floor(F.log(F.length("grams") / 8) / math.log(t.denominator / t.numerator) / (1 + 1e-9)) if t < 1 else F.length("grams").cast("long")
    step = sets.select("fp", step.alias("step"))
    sized = wide.join(step, "fp").withColumn("step", F.explode(F.sequence(F.col("step") - 1, F.col("step"))))
    sized = stage(sized, "steps")
    sized = sized.join(sized.groupBy("gram", "step").agg(F.ceil(F.count(F.lit(1)) / block).alias("k")), ["gram", "step"])
    mine = sized.withColumn("i", F.pmod(F.xxhash64("fp"), "k")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = ["gram", "step", "i", "j"]
    mine = stage(mine.select("gram", "step", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp"), "block-members")
    grouped = _in_rounds(mine, dealt, n_sets, lambda now: now.join(sets, "fp").groupBy(*dealt).applyInArrow(_block(t), "u binary, v binary"), "block-links")
    return named(components(stage(links.unionByName(grouped), "links")))
