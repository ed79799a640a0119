"""Periodic runs and centroid clusters against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.compare import duck, rows
from tidemark.llm import clustering, periodic_runs, queries

DATA = "/root/testdata/sf0.001"


def plain(df):
    # Whole numbers with nulls come as floats from one side.
    return rows(df.astype(object).where(df.notna(), None).map(lambda v: int(v) if isinstance(v, float) and v == int(v) else v))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_cluster_vectors"])
def test_matches_sql(spark, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck(DATA).sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def brute_runs(words, least, turns):
    n, found = len(words), []
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, turns * q):
                part = words[i : j + q]
                if all(any(part[x] != part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "turns"), [(12, 2), (4, 2), (1, 3)])
def test_runs_of_random_words(least, turns):
    r = random.Random(least)
    texts = [[]]
    for _ in range(150):
        words = [r.choice("abc") for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            words += [r.choice("abcd") for _ in range(r.randrange(1, 9))] * r.randrange(1, 9)
        texts.append(words)
    texts += [["a"] * k for k in (1, 11, 12, 13, 200)] + [list("ab") * 40 + list("abc") * 30]
    assert periodic_runs.runs_of(texts, least, turns) == [brute_runs(t, least, turns) for t in texts]
    # One text a row finds the same as many.
    assert [periodic_runs.runs_of([t], least, turns)[0] for t in texts] == periodic_runs.runs_of(texts, least, turns)


def test_runs_of_all_cases(spark):
    r = random.Random(7)
    long = [f"w{r.randrange(3000)}" for _ in range(60_000)]
    long[20_000:20_000] = long[19_000:20_000]
    texts = [None, "", " \n", "a " * 12, "a " * 11, "É x " * 12, " ".join(long), "a b\tc\n" * 5 + "d", "a b\tc\n" * 5 + "d"]
    docs = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_runs int, period string").repartition(3)
    got = sorted(((x["doc_id"] or 0, x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) for x in periodic_runs.periodic_runs(docs).collect()))
    assert got == [
        (0, 0, None, None, None, None), (1, 0, None, None, None, None), (2, 0, None, None, None, None), (3, 1, 0, 12, 1, 12_000), (4, 0, None, None, None, None), (5, 1, 0, 12, 1, 12_000),
        (6, 1, 19_000, 2000, 1000, 2000), (7, 1, 0, 15, 3, 5000), (8, 1, 0, 15, 3, 5000),
    ]
    collapsed = {x["doc_id"]: x["collapsed_sha256"] for x in periodic_runs.periodic_runs(docs).collect()}
    assert collapsed[7] == hashlib.sha256(b"a b c d").hexdigest() and collapsed[None] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def brute_clusters(rows_, k, rounds, scale):
    points = [(i, [int(np.floor(scale * np.float64(c))) for c in x]) for i, x in rows_]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    centroids = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in points:
            groups.setdefault(near(x)[1], []).append(x)
        for j, xs in groups.items():
            centroids[j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    return sorted((i is None, i or 0, near(x)[1], near(x)[0], hashlib.sha256(",".join(map(str, centroids[near(x)[1]])).encode()).hexdigest()) for i, x in points)


@pytest.mark.parametrize(("n", "k", "spread"), [(300, 12, 1.0), (200, 9, 0.004), (6, 16, 1.0), (60, 5, 1e5)])
def test_clusters(spark, n, k, spread):
    """Grids of few places, where ties abound, fewer vectors than centroids, and large components."""
    r = np.random.default_rng(n)
    places = r.normal(size=(6, 4)) * 2 * spread
    data = [(i, (places[i % 6] + r.integers(-2, 3, 4) * spread / 2).astype(np.float32).tolist()) for i in range(n)]
    data += [(3, data[3][1]), (3, data[4][1]), (None, data[5][1])] + [(1000 + i, data[1][1]) for i in range(n // 2)]
    bad = [(7000, None), (7001, []), (7002, [1.0] * 3), (7003, [1.0] * 5), (7004, [1.0, None, 1.0, 1.0]), (7005, [1.0, float("nan"), 1.0, 1.0]), (7006, [float("inf")] * 4)]
    vectors = spark.createDataFrame([(i, x, "c", 1, 2) for i, x in data + bad], "vec_id long, embedding array<float>, cluster string, a int, x int").repartition(5)
    got = clustering.cluster_vectors(vectors, k=k, rounds=4, dim=4).collect()
    assert sorted((x["vec_id"] is None, x["vec_id"] or 0, x["cluster"], x["distance"], x["centroid_sha256"]) for x in got) == brute_clusters(data, k, 4, 256)
    assert {x["inertia"] for x in got} == {sum(x["distance"] for x in got)}
    assert all(x["cluster_inertia"] == sum(y["distance"] for y in got if y["cluster"] == x["cluster"]) for x in got)
    if n == 300:
        assert sum(x["computed"] for x in got) < 0.6 * len(got) * k * 5


def test_clusters_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert clustering.cluster_vectors(none).count() == 0
    with pytest.raises(Exception, match="stay below"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")).count()
