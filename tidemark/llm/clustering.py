"""Centroid clustering of vectors of whole numbers by Lloyd's rounds, most distances skipped by Elkan's bounds.

Every vector carries an upper bound of its distance to the own centroid and a lower bound of that to each other one.
After a round the bounds move by what centroids moved; a centroid whose lower bound, or half of whose distance to the
own centroid, lies above the upper bound can't be the nearest. Bounds are rounded outwards and compared strictly, so
that equal distances are always looked at: they go to the smaller number. What is compared in the end are whole numbers.

Vectors and bounds are staged between rounds; only k centroids and k sums, of bounded size, pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, ship, stage

#: Whole components below this keep squared distances of up to 64 components within 64 bits.
MOST = 1 << 27
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50
STATE = "x binary, a int, u double, l binary, computed long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c`` (one row, or one for each)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest centroids of the rows of ``x``, given a guess ``a``, upper bounds ``u`` and lower bounds ``low`` (both are tightened in place); how many distances it took.

    ``half`` holds half the distances between centroids, rounded down, endless on the diagonal.
    """
    a, took = a.copy(), 0
    exact = np.full(len(x), -1, np.int64)
    open_ = ~(half.min(axis=1)[a] > u)
    for j in range(len(centroids)):
        maybe = lambda rows: rows[(a[rows] != j) & ~(low[rows, j] > u[rows]) & ~(half[a[rows], j] > u[rows])]  # noqa: B023, E731
        rows = maybe(np.flatnonzero(open_))
        loose = rows[exact[rows] < 0]
        if len(loose):
            exact[loose] = squared(x[loose], centroids[a[loose]])
            root, took = np.sqrt(exact[loose].astype(float)), took + len(loose)
            u[loose], low[loose, a[loose]] = root * UP, root * DOWN
            rows = maybe(rows)
        if not len(rows):
            continue
        d = squared(x[rows], centroids[j])
        root, took = np.sqrt(d.astype(float)), took + len(rows)
        low[rows, j] = root * DOWN
        nearer = (d < exact[rows]) | ((d == exact[rows]) & (j < a[rows]))
        won = rows[nearer]
        a[won], exact[won], u[won] = j, d[nearer], root[nearer] * UP
    return a, took


def _half(c: np.ndarray) -> np.ndarray:
    d = np.array([squared(c, one) for one in c], dtype=float).reshape(len(c), len(c))
    out = np.sqrt(d) * DOWN / 2
    np.fill_diagonal(out, np.inf)
    return out


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() >= MOST:
        raise ValueError(f"components times {scale} must stay below {MOST} for exact distances")
    return out.astype(np.int64)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _rows(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


def _moved(state: DataFrame, id_col: str, centroids: np.ndarray, moves: np.ndarray, dim: int) -> DataFrame:
    """The state after centroids moved to these places by these distances (rounded up): bounds follow, then every vector is assigned."""
    half, k = _half(centroids), len(centroids)

    def run(batches):
        for b in batches:
            n = b.num_rows
            x, low = _matrix(b["x"], np.int64, dim), _matrix(b["l"], np.float64, k)
            a, u = b["a"].to_numpy().copy(), (b["u"].to_numpy() + moves[b["a"].to_numpy()]) * UP
            low = np.maximum((low - moves) * np.where(low > moves, DOWN, 1), 0)
            was = b["computed"].to_numpy()
            a, took = assign(x, a, u, low, centroids, half)
            per = np.full(n, took // max(n, 1))
            per[: took - per.sum()] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b["x"], pa.array(a, pa.int32()), pa.array(u), _rows(low), pa.array(was + per)], names=[id_col, "x", "a", "u", "l", "computed"])

    return state.mapInArrow(run, state.schema)


def _means(state: DataFrame, dim: int, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the clusters' means, exact; a cluster without vectors stays where it was."""
    names = [f"x{i}" for i in range(dim)]

    def run(batches):
        for b in batches:
            x, a = _matrix(b["x"], np.int64, dim), b["a"].to_numpy()
            found, back = np.unique(a, return_inverse=True)
            sums = np.zeros((len(found), dim), np.int64)
            np.add.at(sums, back, x)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.bincount(back, minlength=len(found)), pa.int64()), *map(pa.array, sums.T.copy())], names=["a", "n", *names])

    parts = state.select("x", "a").mapInArrow(run, "a int, n long, " + ", ".join(f"{c} long" for c in names))
    out = centroids.copy()
    # A row per centroid.
    for r in parts.groupBy("a").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect():
        out[r["a"]] = [int(r[c]) // r["n"] for c in names]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Clusters of the vectors of ``dim`` components, none of them null, NaN or endless; a component counts as floor(scale * x).

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id``; each of ``rounds`` rounds assigns all
    vectors to the nearest (ties: the smaller number) and moves centroids to the floor of their vectors' means; then
    vectors are assigned once more. Rows: the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    (sums of distances), ``centroid_sha256``, and ``computed``: distances that the vector's batch needed, per vector.

    Other vectors have no row; a table without vectors gives none; fewer than ``k`` vectors are as many centroids. Rows
    that repeat an id, and copies, count each; a null id stands last in the choice of centroids, and equal ids go by
    their components. Other columns are not read. Components of ``MOST`` / scale or more raise an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col(vec_col)
    fit = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where((F.size(e) == dim) & fit).select(F.col(id_col), e.cast("array<double>").alias("x"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    centroids = _whole(np.array([r["x"] for r in first.collect()], dtype=float).reshape(-1, dim), scale)
    k = len(centroids)

    def begin(batches):
        for b in batches:
            x = _whole(b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim), scale)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(x), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), _rows(np.zeros((n, k))), pa.array(np.zeros(n, np.int64))], names=[id_col, "x", "a", "u", "l", "computed"])

    schema = f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {STATE}"
    state, moves = stage(kept.mapInArrow(begin, schema), "vectors"), np.zeros(k)
    for r in range(rounds + 1):
        was, state = state, stage(_moved(state, id_col, centroids, moves, dim), "vectors")
        discard(was)
        if r < rounds and k:
            new = _means(state, dim, centroids)
            moves, centroids = np.sqrt(squared(new, centroids).astype(float)) * UP, new
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def last(batches):
        for b in batches:
            a = b["a"].to_numpy()
            d = squared(_matrix(b["x"], np.int64, dim), centroids[a]) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b["a"], pa.array(d, pa.int64()), pa.array([sha[i] for i in a], pa.string()), b["computed"]], names=[id_col, "cluster", "distance", "centroid_sha256", "computed"])

    kind = schema.split(", ")[0]
    done = stage(state.mapInArrow(last, f"{kind}, cluster int, distance long, centroid_sha256 string, computed long"), "clusters")
    discard(state)
    own = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = own.agg(F.sum("cluster_inertia").alias("inertia"))
    return done.join(F.broadcast(own.crossJoin(F.broadcast(whole))), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> str:
    """The same in SQL: every distance of every round."""
    out = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m FROM v, c{r} c GROUP BY v.r)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT a.m.c AS c, unnest(v.x) AS x, unnest(range({dim})) AS i FROM a{r} a JOIN v USING (r)) GROUP BY c, i)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c) m USING (c))")
    return "WITH " + ",\n".join(out) + (
        f"\nSELECT v.vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.m.c"
    )
