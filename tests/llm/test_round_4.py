"""What the fourth review found in the corpus operators."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_dedup import links, table
from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import _chosen, _levels, _quarters, _sift, pack, similar_components

T = Fraction(9, 10)


def test_levels_of_the_most_common_ngrams_take_a_byte_a_cell(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", 64)
    monkeypatch.setattr(ngram_join, "MOST_COMMON", 12)
    # Of each level two n-grams, one of which shares its cell with one of the level above.
    often = spark.createDataFrame([(64 * level + level, level) for level in range(1, 9)] + [(-64 + level + 1, level) for level in range(1, 9)], "gram long, level int")
    levels = _levels(often)
    assert len(levels) == 64 and levels.dtype == np.uint8 and levels.tolist() == [0, 0, 0, *range(3, 9), 8] + [0] * 54


def test_quarters_tell_most_strangers_apart_and_no_linked_sets():
    r = np.random.default_rng(4)
    draw = lambda n: np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
    pairs = []
    for k in range(300):
        n, base = int(r.integers(1, 400)), draw(400)
        same = base[: max(n - (k % 40) * n // 400, 1)]
        pairs.append((np.union1d(same, draw(k % 3)), base[:n]) if k < 200 else (draw(n), draw(n)))
    sets = [s for p in pairs for s in p]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(len(sets))], pa.binary()), pa.array([pack(s) for s in sets], pa.binary())], names=["fp", "grams"])
    (out,) = _quarters([batch])
    fps, sizes, quarters = (out.column(i) for i in range(3))
    assert sizes.to_pylist() == [len(s) for s in sets]
    both = pa.array([len(x) + len(y) for x, y in pairs], pa.int64())
    kept = {x for b in _sift(T)([pa.RecordBatch.from_arrays([fps[::2], fps[1::2], both, quarters[::2], quarters[1::2]], names=["a", "b", "both", "x", "y"])]) for x in b.column(0).to_pylist()}
    linked = {str(2 * i).encode() for i, (x, y) in enumerate(pairs) if ngram_join.linked(len(np.intersect1d(x, y)), len(x), len(y), T)}
    strangers = {str(2 * i).encode() for i in range(200, 300)}
    assert len(linked) > 50 and linked <= kept and len(strangers & kept) < 20


def test_many_keys_are_looked_up_in_several_readings(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, i % 3, str(i)) for i in range(60)], "id long, dig long, text string")
    keys = rows.where("cast(text as int) % 2 = 0").select("id", "dig").distinct()
    want = sorted(r["text"] for r in _chosen(rows, keys, 1000).collect())
    many = _chosen(rows, keys, 5)
    assert sorted(r["text"] for r in many.collect()) == want and len(want) > 30
    assert "SortMergeJoin" not in many._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 8])
def test_ngram_join_whatever_is_known_of_common_ngrams(spark, monkeypatch, most):
    """More n-grams are common than levels are kept of, cells are shared, and pairs and blocks take several rounds."""
    monkeypatch.setattr(ngram_join, "MOST_COMMON", most)
    monkeypatch.setattr(ngram_join, "CELLS", 16)
    monkeypatch.setattr(ngram_join, "MOST_SENT", 20)
    r = np.random.default_rng(most)
    base = [[f"w{x}" for x in r.integers(0, 60, 80)] for _ in range(6)]
    texts = []
    for k in range(150):
        b = list(base[k % 2 if k < 100 else k % 6])
        for _ in range(int(r.integers(0, 4))):
            b[int(r.integers(0, 80))] = f"w{int(r.integers(0, 60))}"
        texts.append(" ".join(b))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_components(table(spark, texts), small=4, block=8).collect()}
    assert got == links(texts, 3, T)
