"""Exact dedup, suffix dedup and the n-gram join against brute force."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pytest

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.ngram_join import similar_components
from tidemark.llm.suffix_dedup import multikey_quicksort, remove_repeats

SCHEMA = "doc_id long, text string, source string, id string, dig string, fp string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA).repartition(3)


def white(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("counters", [4, 1024])
def test_exact_dedup(spark, counters):
    r = random.Random(1)
    texts = [None, "", " ", "\n\t", "a  b", "a b", "A b"] + ["hot \n text"] * 150 + [f"t{r.randrange(60)}" for _ in range(150)] + ["x" * 100_000] * 2
    got = {x["doc_id"]: x for x in exact_dedup(table(spark, texts), counters=counters).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[white(t)].append(i)
    assert len(got) == len(texts)
    for t, members in groups.items():
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (members[0], len(members), i == members[0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_of_null_ids_repeated_rows_and_nothing(spark):
    got = exact_dedup(table(spark, ["a", "a", "b", "c", "c"], [None, 3, None, 5, 5])).collect()
    assert sorted((x["doc_id"] or -1, x["keep_id"] or -1, x["kept"]) for x in got) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 5, True), (5, 5, True)]
    assert exact_dedup(table(spark, ["a"]).limit(0)).count() == 0


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "letters"), [(40, 12, "abcdé "), (60, 10, "ab"), (400, 100, "abc é")])
def test_suffix_dedup(spark, length, gram, letters):
    r = random.Random(length)
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [some(length + r.randrange(-3, 60)) for _ in range(4)]
    texts = [None, "", "a" * 3 * length, some(5)] + [some(r.randrange(200)) + r.choice(passages) + some(r.randrange(300)) for _ in range(40)]
    texts += [*texts[10:14], texts[20][7:], "ab" * length, some(2 * length) + passages[0] + some(3) + passages[0], *[texts[5]] * 9]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in remove_repeats(table(spark, texts), length=length, gram=gram).collect()}
    assert got == dict(enumerate(covered(texts, length)))


def test_suffix_dedup_counts_repeated_rows_and_takes_nothing(spark):
    got = remove_repeats(table(spark, ["q" + "xyz" * 200] * 2, [7, 7]), length=400).collect()
    assert [x["n_removed"] for x in got] == [601, 601]
    assert remove_repeats(table(spark, ["a"]).limit(0)).count() == 0


def passages(texts, ids, n):
    """Ids of the documents that share a string of n words with another one."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    holders = collections.defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        w = word.findall(t or "")
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add((i, t))
    return {i for who in holders.values() if len(who) > 1 for i, _ in who}


@pytest.mark.parametrize(("words", "gram", "kinds"), [(10, 3, 40), (12, 2, 3), (50, 8, 400)])
def test_shared_passages_of_words(spark, words, gram, kinds):
    r = random.Random(words)
    some = lambda n: [f"w{r.randrange(kinds)}" for _ in range(n)]
    shared = [some(words + r.randrange(-1, 4)) for _ in range(5)]
    texts = [None, "", "x " * 3 * words, "  ", " ".join(some(words))]
    texts += [" ".join(some(r.randrange(2 * words)) + (r.choice(shared) if r.random() < 0.4 else []) + some(r.randrange(3 * words))) for _ in range(60)]
    twice = some(words + 2)
    texts += [" ".join(twice + some(5) + twice), texts[7], texts[7] + " z", *[" ".join(some(9) + shared[0] + some(9)) for _ in range(30)]]
    ids = [*range(len(texts)), 500, 500]
    texts += [" ".join(some(3 * words))] * 2
    got = {x["doc_id"] for x in remove_repeats(table(spark, texts, ids), words=words, word_gram=gram).where("shares_passage = 1").collect()}
    assert got == passages(texts, ids, words)
    if kinds > 3:
        assert 500 not in got and ids[65] not in got


def test_runs_of_long_documents_are_those_of_their_stretches(monkeypatch):
    import numpy as np

    from tidemark.llm import suffix_dedup
    from tidemark.llm.common import prefix_hash

    r = np.random.default_rng(6)
    raw = r.integers(0, 3, 12_000).astype(np.uint8)
    offsets = np.array([0, 30, 30, 7000, 7039, 12_000])
    prefix = lambda a, b: prefix_hash(raw[a:b])

    def by_window(found):
        return {w: (row, anchor, at) for row, first, last, anchor, at, _ in zip(*(x.tolist() for x in found), strict=True) for w in range(first, last + 1)}

    whole = by_window(suffix_dedup.runs_of(prefix, offsets, 40, 10))
    assert set(whole) == {w for a, b in zip(offsets[:-1], offsets[1:], strict=True) for w in range(a, b - 39)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    assert by_window(suffix_dedup.runs_of(prefix, offsets, 40, 10)) == whole


def test_multikey_quicksort_sorts_by_all_tokens():
    import numpy as np

    r = np.random.default_rng(3)
    for kinds in ((3, 2, 4, 50), (1, 1, 1), (10**6, 2)):
        tokens = [r.integers(-k, k, 3000) for k in kinds]
        order = multikey_quicksort(tokens)
        rows = list(zip(*(t[order].tolist() for t in tokens), strict=True))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(3000))


def links(texts, n, t):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for x in texts:
        w = word.findall((x or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and k * t.denominator >= t.numerator * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "t", "small", "block"), [(3, Fraction(9, 10), 48, 256), (3, Fraction(9, 10), 3, 6), (5, Fraction(4, 5), 6, 16)])
def test_ngram_join(spark, n, t, small, block):
    r = random.Random(n * small)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 20, 60, 150]))] for _ in range(12)]
    texts = [None, "", "  ", "A b", "a B", "x", "very " * 5000]
    for k in range(200):
        b = list(r.choice(base[:3] if k < 120 else base))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(" ".join(b))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_components(table(spark, texts), n=n, t=t, small=small, block=block).collect()}
    assert got == links(texts, n, t)


def test_ngram_join_tells_shingles_apart_whose_hashes_begin_alike(spark):
    import numpy as np

    from tidemark.llm.common import shingles

    alike = ["w152 w10 w198", "w117 w77 w43"]
    a, b = (int(shingles(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), 3)[0][0]) for x in alike)
    assert a != b and a >> 24 == b >> 24
    texts = []
    for n in (17, 18, 38, 44, 50):
        words = " ".join(f"x{n}y{i}" for i in range(n))
        texts += [f"{words} {x}" for x in alike]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_components(table(spark, texts)).collect()}
    assert got == links(texts, 3, Fraction(9, 10))


@pytest.mark.parametrize(("t", "shared"), [(Fraction(3, 5), 7), (Fraction(1, 2), 9)])
def test_ngram_join_of_strangers_with_a_common_passage(spark, t, shared):
    r = random.Random(shared)
    common = " ".join(f"c{i}" for i in range(shared))
    texts = [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(4, 16))) for _ in range(90)]
    texts += [texts[3] + " z", texts[5] + " z z", common, common + " q", common + " " + "m " * 40]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_components(table(spark, texts), t=t, small=4, block=8).collect()}
    assert got == links(texts, 3, t)


def test_groups_of_the_same_near_copies_are_dealt_once(spark):
    from tidemark.llm.ngram_join import _merged

    groups = [(g, bytes([c])) for g in range(20) for c in range(40) if (g + c) % 9] + [(99, bytes([200 + c])) for c in range(10)]
    # A chain of groups stays apart: as one it would have more pairs.
    groups += [(1000 + g, bytes([1, c])) for g in range(20) for c in range(10 * g, 10 * g + 11)]
    got = _merged(spark.createDataFrame(groups, "gram long, fp binary"), 4).collect()
    of = {}
    for x in got:
        of.setdefault(x["gram"], set()).add(bytes(x["fp"]))
    before = {}
    for g, c in groups:
        before.setdefault(g, set()).add(c)
    assert all(any(b <= a for a in of.values()) for b in before.values())
    assert {bytes([c]) for c in range(40)} in of.values() and len(of) == 1 + 1 + 20


def test_ngram_join_of_null_ids_and_nothing(spark):
    got = similar_components(table(spark, ["a b c d", "a b c d", ""], [None, 4, None])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in got) == [(-1, -1), (-1, 4), (4, 4)]
    assert similar_components(table(spark, ["a"]).limit(0)).count() == 0


def opposite(n):
    """Two words of n bytes that any polynomial hash modulo 2**64 takes for one from 1,024 bytes on."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_a_polynomial_hash_takes_for_one(spark, n):
    a, b = opposite(n)
    rest = [f"w{i}" for i in range(12)]
    texts = [" ".join([*rest, a]), " ".join([*rest, b]), a, b, " ".join([*rest, a])]
    got = {r["doc_id"]: r["component_id"] for r in similar_components(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
