"""The other operators: against brute force, exact round trips and held-out accuracy."""

import collections
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.compare import duck, rows
from tidemark.llm import decontam, lang_id, license_scan, queries, token_output, toxicity, url_filter
from tidemark.llm.mixing import mix_sources

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, lang string, id string, score string, lang_pred string, copies string"


def table(spark, texts, sources=None, langs=None, ids=None):
    n = range(len(texts))
    return spark.createDataFrame([(ids[i] if ids else i, texts[i], sources[i] if sources else None, langs[i] if langs else None, "x", "y", "z", "c") for i in n], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def db():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# -- URL filters

def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x", "http://example.org/en/1291?q=://", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/", "http://Casino-win.com/en", "http://x.net/free-casino/2", "http://org", "http://x.net?casino", "http://example.org/en/2"] + ["http://x.com/de/"] * 3
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {x["page_id"] or 0: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.filter_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/1291", "example.org/en/1", "block")
    assert got[5][2:] == ("org/", "allow") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8] == ("casino-win.com", "/en", None, "block") and got[9][2:] == (None, "block")
    assert got[10] == ("org", "", None, "allow") and got[11] == ("x.net", "", None, "allow") and got[12][2:] == ("org/", "allow")
    assert len(got) == len(urls) and url_filter.filter_urls(pages.limit(0)).count() == 0


# -- token files

def test_rules_of_two_literals_and_long_urls(spark):
    urls = ["http://x.net/" + "a/" * 50_000 + "free-casino", "http://x.net/free/b/casino", "http://x.net/best_poker/cheap-pills?q", "http://x.net/q?free-casino"]
    t = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(0, "gambling:free-casino", "block"), (1, "", "allow"), (2, "drugs:cheap-pills,gambling:best-poker", "block"), (3, "", "allow")]
    found = url_filter.filter_urls(t)
    assert [(x["page_id"], x["matched"], x["verdict"]) for x in found.orderBy("page_id").collect()] == want
    # Beyond what is broadcast: the same.
    most, url_filter.MOST_RULES = url_filter.MOST_RULES, 5
    try:
        assert [(x["page_id"], x["matched"], x["verdict"]) for x in url_filter.filter_urls(t).orderBy("page_id").collect()] == want
    finally:
        url_filter.MOST_RULES = most


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(2)
    texts = [None, "", "<|endoftext|> a", "it's  We'll\n \n12 34 _x_ été 日本 \x1c\x85 ok", "long " * 60_000] + [" ".join(r.choice(["alpha", "beta,", "été", "12", "\n\n", "'s"]) for _ in range(r.randrange(200))) for _ in range(60)]
    ids = list(range(3, 3 + len(texts)))
    ids[5], ids[6], ids[7] = None, 9, 9
    files = token_output.write_tokens(table(spark, texts, ids=ids), path, folder=f"file://{tmp_path}/t")
    got = token_output.read_tokens(files).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    want = sorted(((i is not None, i or 0, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts, strict=True)), key=lambda x: x[:2])
    got = sorted(got, key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [i if there else None for there, i, _ in want]
    at = 0
    seen = sorted((x["n_tokens"], x["ids_crc32"]) for x in got)
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    assert seen == sorted((len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for _, _, t in want)


def test_one_document_is_read_from_one_frame_and_damage_is_seen():
    docs = [(i, np.full(i % 7 * 1000, i, "<u4").tobytes()) for i in range(400)]
    to = io.BytesIO()
    token_output.write_frames(to, iter(docs))
    data = to.getvalue()
    file = token_output.FrameFile(io.BytesIO(data), len(data))
    assert len(file.sums) > 5 and all(file.read(i).tobytes() == d for i, d in docs)
    assert [(i, bytes(d)) for i, _, d in file.scan()] == docs
    assert b"".join(d for _, d in docs) == b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() for _ in range(1))
    broken = bytearray(data)
    broken[int(file.starts[2]) + 9] ^= 1
    bad = token_output.FrameFile(io.BytesIO(bytes(broken)), len(data))
    assert bad.read(1).tobytes() == docs[1][1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.frame(2)


def test_common_pieces_stay_in_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 40)
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    learned = []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(new), learn(new)))
    for k in range(30):
        text = f"the common words,  {' '.join(f'w{chr(97 + k % 26)}{i}x' for i in range(20))}\n \tend's {k}_"
        assert encoder([text]) == encoder.whole([text])
    assert learned.count(" common") == learned.count("'s") == 1


# -- mixing

def test_mix_comes_near_its_targets(spark):
    r = random.Random(5)
    sources = [r.choice(["hot"] * 6 + ["b", "c", None]) for _ in range(600)] + ["tiny", "none"]
    texts = ["w " * r.randrange(1, 40) for _ in range(600)] + ["a b", None]
    got = mix_sources(table(spark, texts, sources)).collect()
    again = mix_sources(table(spark, texts, sources)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    by = {}
    for x in got:
        e = by.setdefault(x["source"], [x["target"], x["source_size"], 0, 0])
        e[2] += x["taken"]
        e[3] = max(e[3], x["size"])
        assert x["taken"] % max(x["size"], 1) == 0 and x["taken"] <= 3 * x["size"]
    assert abs(sum(t for t, *_ in by.values()) - sum(s for _, s, *_ in by.values())) < 1e-6 * 20_000
    assert all(abs(taken - target) <= 2 * most for target, _, taken, most in by.values())
    assert all(target <= 3 * size + 1e-9 for target, size, *_ in by.values())
    assert mix_sources(table(spark, ["a"]).limit(0)).count() == 0


# -- license scans

def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_places(spark):
    texts = [None, "", "MIT  License mit license, cc-by cc by", "é mit\nlicense", "gnu general public licenses", "The GNU General Public License; Apache-License!", "mit licenseé", "submit license", "x " * 50_000 + "mit license"]
    got = {x["doc_id"]: x for x in license_scan.scan_licenses(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == scan_by_hand(t)
        assert set(x["base_labels"].split(",")) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert license_scan.scan_licenses(table(spark, ["a"]).limit(0)).count() == 0


def test_license_texts_are_known_by_their_sentences():
    from tidemark.llm.license_texts import TEXTS, pattern

    s = license_scan.Scanner()
    known = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software [...] to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        "bsd": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "isc": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
        "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,",
        "gpl": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by",
        "lgpl": "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "agpl": "offer all users interacting with it remotely through a computer network",
        "mpl": "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "cc-by-nc-sa": "See https://creativecommons.org/licenses/by-nc-sa/4.0/ for more",
        "cc0": "To the extent possible under law, the author of this file has waived all copyright and related or neighboring rights",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "proprietary": "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    }
    for label, text in known.items():
        assert s.scan(text.encode())[5] == label, (label, s.scan(text.encode()))
    for prose in ("The author disclaims nothing and redistributes the library with a fee.", "They deal in fonts, freedom and stuff; the basis of the agreement is a title.", "A perl of a community with evil hope, compliance and production."):
        assert s.scan(prose.encode())[5] == ""
    assert len(license_scan.SIGNATURES) > 400 and len(TEXTS) > 110
    for label, word, sentence in TEXTS:
        # What any match holds is left when optional groups and choices go: the keyword is among it, or no text of it would be looked at.
        for whole in re.split(r"\|(?![^()]*\))", sentence):
            sure = whole
            while "(?:" in sure:
                sure = re.sub(r"\(\?:[^()]*\)(?:[?*]|\{0,\d\})?", " ", sure)
            assert word in re.sub(r"\[[^]]*\]", "", sure).split(), (label, word, sure)
        re.compile(pattern(sentence))


def test_license_rules_and_suppression():
    s = license_scan.Scanner()
    assert len(license_scan.SIGNATURES) > 200
    assert s.scan(b"Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    assert s.scan(b"SPDX-License-Identifier: GPL-3.0-only")[5] == "gpl"
    assert s.scan(b"licensed under the GNU Lesser General Public License, version 2.1")[5] == "lgpl"
    kept = s.detections(b" licensed under the apache license version 2 0 ", {b"licensed", b"apache"})
    assert [(k[2].label, k[2].priority) for k in kept] == [("apache", 80)]


def test_short_identifiers_and_bare_names():
    s = license_scan.Scanner()
    for text, label in (("MIT", "mit"), ("ISC", "isc"), ("BSL-1.0", "boost"), ("Zlib", "zlib"), ("Artistic-2.0", "artistic"), ("PSF-2.0", "psf"), ("BSD-3-Clause", "bsd"), ("CC-BY-SA-4.0", "cc-by-sa"), ("LGPL-2.1-only", "lgpl"), ("EUPL-1.2", "eupl")):
        assert label in s.scan(f"x SPDX-License-Identifier: {text}\ny".encode())[5].split(","), text
    for text, label in (("Mozilla Public License", "mpl"), ("ISC License", "isc"), ("Zlib License", "zlib"), ("Boost Software License", "boost")):
        assert s.scan(f"some {text} here".encode())[5:] == (label, 0.4)
    assert s.scan(b"an apache and a gnu open the server in common")[5] == ""


def test_priority_decides_where_detections_overlap_in_part():
    rule = lambda label, priority, pattern: license_scan.Signature(label, priority, pattern, 0.5, ("b",))
    for first, second, want in ((10, 20, ["right"]), (20, 10, ["left"]), (10, 10, ["right"])):
        rules = sorted([rule("left", first, "a b"), rule("right", second, "b c d"), rule("inner", 99, "c")], key=lambda r: -r.priority)
        kept = license_scan.Scanner(tuple(rules), ()).detections(b" a b c d e ", {b"a", b"b", b"c", b"d", b"e"})
        assert [k[2].label for k in kept] == want
    # Against trying all detections against all others.
    r = random.Random(4)
    words = "b c d e".split()
    rules = tuple(sorted((rule(f"r{i}", r.randrange(4), " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for i in range(9)), key=lambda x: -x.priority))
    for _ in range(50):
        line = (" b " + " ".join(r.choice(words) for _ in range(25)) + " ").encode()
        found = [(m.start(), m.end(), i) for i, x in enumerate(rules) for m in re.finditer(rf"(?<= ){x.pattern}(?= )".encode(), line)]
        whole = [f for f in found if not any(g != f and g[0] <= f[0] and f[1] <= g[1] and (g[1] - g[0] > f[1] - f[0] or g[2] < f[2]) for g in found)]
        kept = []
        for f in sorted(whole, key=lambda f: (-rules[f[2]].priority, f[0] - f[1], f[0])):
            if all(f[1] <= k[0] or k[1] <= f[0] for k in kept):
                kept.append(f)
        assert [(a, b, x.label) for a, b, x in license_scan.Scanner(rules, ()).detections(line, {w.encode() for w in words})] == [(a, b, rules[i].label) for a, b, i in sorted(kept)]


# -- language ID

def plain_ranks(text, ranks=300):
    """n-grams of 1 to 3 characters by falling frequency, counted one by one."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    if not low.split():
        return []
    line = " " + " ".join(low.split()) + " "
    count = collections.Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " ")
    return sorted(count, key=lambda g: (-count[g], len(g), [ord(c) for c in g]))[:ranks]


def test_predictions_are_those_of_plain_out_of_place_distances():
    r = random.Random(5)
    letters = {"a": "aäbcdeßé", "b": "xyzabc", "c": "дежзи", "d": "aeiou𝔸𝔹"}
    text = lambda k, n: "".join(r.choice(letters[k] + "  .,1\n") for _ in range(n))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    learned = {k: plain_ranks(text(k, 3000)) for k in letters}
    profiles = lang_id.Profiles({k: [code(g) for g in v] for k, v in learned.items()})
    for sample in ["", " .1", "A", "ÄÖ x", *[text(r.choice("abcd"), r.randrange(1, 400)) + text(r.choice("abcd"), r.randrange(60)) for _ in range(150)]]:
        mine = plain_ranks(sample)
        far = {k: sum(abs(v.index(g) - i) if g in v else 300 for i, g in enumerate(mine)) / (300 * max(len(mine), 1)) for k, v in learned.items()}
        want = ("und", 0.0) if not mine else (min(sorted(far), key=far.get), round(1 - min(far.values()), 6))
        assert profiles.predict(sample) == want


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op8_lang_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 100
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    learned = lang_id.learn_profiles(table(spark, ["the cat and the dog", "le chat et le chien", None, "x"], langs=["en", "fr", "en", None]))
    docs = table(spark, [None, "", "123 !?", "the dog and the cat " * 4000, "le chien", "\U00010400 a"])
    got = {x["doc_id"]: x["lang_pred"] for x in lang_id.identify(docs, learned).collect()}
    assert [got[i] for i in range(5)] == ["und", "und", "und", "en", "fr"]
    assert sorted(x["doc_id"] for x in lang_id.keep_known(docs, learned, least=0.0).collect()) == [3, 4, 5]
    none = lang_id.learn_profiles(table(spark, ["a"]).limit(0))
    assert lang_id.identify(docs, none).where("lang_pred = 'und'").count() == 6
    assert lang_id.identify(docs.limit(0), learned).count() == 0


def test_unlearned_languages_and_gibberish_go(spark):
    import corpus_pipeline as p

    r = random.Random(10)
    letters = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))
    bad = [letters(n) for n in (20, 100, 400)] + [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa.",
    ]
    clean = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    docs = clean.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(bad)], clean.schema))
    got = p.language(spark, docs, SMALL)
    assert got.columns == docs.columns and got.where("doc_id < 0").count() == 0
    lost = docs.join(got, "doc_id", "left_anti").where("doc_id >= 0")
    assert lost.where(F.col("text").rlike("[A-Za-z]")).count() == 0 and clean.where("length(text) < 60").count() > 5
    assert lang_id.learn_least(docs.where("doc_id < 0")) == lang_id.learn_least(docs.limit(0)) == lang_id.LEAST


def test_languages_are_learned_from_all_documents(spark):
    letters = "abcdefghijklmnopqrst"
    texts = [c for k, c in enumerate(letters) for _ in range(300 + k)]
    docs = table(spark, texts, langs=["en"] * len(texts))
    (_, grams, rank), = lang_id.learn_profiles(docs).of
    found = [g for _, g in sorted(zip(rank, grams, strict=True)) if g < 1 << 21]
    assert "".join(map(chr, found)) == letters[::-1]


def test_least_score_comes_from_all_documents(spark):
    # The odd documents alone decide the quantile; a sample of 1,500 holds a part of them.
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "cat", "and", "dog"]) for _ in range(6)) for _ in range(7000)] + ["the " + "".join(r.choice("jkqvwxyz") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    docs = table(spark, texts, langs=["en"] * len(texts))
    out = {x["doc_id"] for x in docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("least")), F.lit(4)) == 0).collect()}
    counts = collections.Counter()
    for i, text in enumerate(texts):
        if i not in out:
            counts.update(dict(zip(*(x.tolist() for x in lang_id.ngrams(text)), strict=True)))
    inner = lang_id.Profiles({"en": sorted(counts, key=lambda g: (-counts[g], g))[: lang_id.RANKS]})
    scores = [inner.predict(texts[i])[1] for i in sorted(out)]
    assert lang_id.learn_least(docs) == pytest.approx(lang_id.PART * np.quantile(scores, lang_id.QUANTILE))


# -- toxicity

def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    texts = [b"an idiot said this", b"all is well in the old town", b"moron"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    v = toxicity.Vocabulary(raw, offsets)
    first, row = toxicity.windows(v.counts)
    ids = toxicity.window_ids(v.ids, first, np.minimum(v.counts[row], toxicity.STEPS), len(v.bucket))
    m = {k: a.astype(np.float64) for k, a in toxicity.start_model(r).items()}
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = toxicity.gradients(m, v, ids, y, w)
    for name in ("in", "rec", "bias", "attend", "out", "base", "chars", "words"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        keep, e = m[name][at], 1e-3
        m[name][at] = keep + e
        up = toxicity.gradients(m, v, ids, y, w)[0]
        m[name][at] = keep - e
        down = toxicity.gradients(m, v, ids, y, w)[0]
        m[name][at] = keep
        assert abs((up - down) / (2 * e) - g[name][at]) < 0.05 * abs(g[name][at]) + 2e-3, name


def test_window_logits_are_those_of_a_plain_forward_pass():
    r = np.random.default_rng(8)
    m, H = toxicity.start_model(r), toxicity.HIDDEN
    x = np.concatenate([r.standard_normal((40, 2 * toxicity.DIM)).astype(np.float32), np.zeros((1, 2 * toxicity.DIM), np.float32)])
    ids = r.integers(0, 40, (7, toxicity.STEPS))
    for k, n in enumerate((toxicity.STEPS, 1, 2, 30, 63)):
        ids[k, n:] = 40
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for row, got in zip(ids, toxicity.window_logits(m, x, ids), strict=True):
        words = [x[i].astype(float) for i in row if i != 40]
        states = np.zeros((len(words), 2 * H))
        for d in (0, 1):
            h = np.zeros(H)
            for t in range(len(words)) if d == 0 else reversed(range(len(words))):
                p, a = words[t] @ m["in"][d] + m["bias"][d], h @ m["rec"][d]
                z, gate = sigmoid(p[:H] + a[:H]), sigmoid(p[H : 2 * H] + a[H : 2 * H])
                c = np.tanh(p[2 * H :] + gate * a[2 * H :])
                h = (1 - z) * c + z * h
                states[t, d * H : (d + 1) * H] = h
        weight = np.exp(states @ m["attend"])
        assert abs((weight / weight.sum()) @ (states @ m["out"]) + m["base"][0] - got) < 1e-4


def test_windows_cover_every_word_and_batches_do_not_matter():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        first, _ = toxicity.windows(np.array([n]))
        assert set(range(n)) == {i for f in first for i in range(f, min(f + toxicity.STEPS, n))}
    m = toxicity.start_model(np.random.default_rng(2))
    texts = [b"", b"one two", b"three " * 200, b"?", b"four five"]
    whole = toxicity.document_scores(m, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 0.25)[0]
    each = [toxicity.document_scores(m, np.frombuffer(t, np.uint8), np.array([0, len(t)]), 0.25)[0][0] for t in texts]
    assert np.allclose(whole, each, atol=1e-5) and whole[0] == whole[3] == 0.25


def test_toxicity_held_out(spark):
    r = random.Random(4)
    words, bad = [f"word{i}" for i in range(300)], ["idiot", "moron", "scum"]
    texts, y = [None, "", "!!"], [0, 0, 0]
    for i in range(700):
        t = [r.choice(words) for _ in range(r.randrange(5, 150))]
        if i % 3 == 0:
            t[r.randrange(len(t))] = r.choice(bad) + r.choice(["", "!", "%%%"])
        texts.append(" ".join(t))
        y.append(int(i % 3 == 0))
    docs = table(spark, texts)
    labels = spark.createDataFrame([*enumerate(y), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels.where("doc_id is null or doc_id % 5 != 0"), sample=300)
    got = toxicity.score_toxicity(docs, model).join(labels.dropna(), "doc_id").where("doc_id % 5 = 0")
    assert got.where("predicted = toxic").count() >= 0.95 * got.count() > 100
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    alike = toxicity.learn_toxicity(docs, labels.where("toxic = 0"))
    assert toxicity.score_toxicity(docs, alike).where("predicted = 1").count() == 0


# -- decontamination

def index_of(texts, answers=None):
    """The index that the tasks build of these items, numbered from 0."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(answers or [None] * len(texts), pa.string())], names=["nr", "text", "answer"])
    items = [r for b in decontam._items([batch]) for r in b.to_pylist() if r["words"]]
    df = collections.Counter(w for r in items for w in set(r["words"]))
    terms = [[{"term": w, "tf": c, "df": df[w]} for w, c in sorted(collections.Counter(r["words"]).items())] for r in items]
    rows = [(r["nr"], r["words"], r["cut"], r["apart"], t) for r, t in zip(items, terms, strict=True)]
    return decontam.Index(rows, len(rows), sum(len(r["words"]) for r in items) / max(len(items), 1))


@pytest.mark.parametrize(("vocabulary", "items"), [(30, 60), (400, 61), (3000, 300)])
def test_skipped_blocks_lose_no_item(vocabulary, items):
    r = random.Random(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    some = lambda n: [r.choice(words[: 12 if r.random() < 0.5 else vocabulary]) for _ in range(n)]
    bench = [some(r.randrange(4, 40)) for _ in range(items)]
    texts = [some(r.randrange(300)) for _ in range(60)] + [some(30) + r.choice(bench) + some(r.randrange(90)) for _ in range(40)] + [[]]
    index = index_of([" ".join(t) for t in bench])
    raw = [" ".join(t).encode() for t in texts]
    hashes, counts = decontam.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    skipped = {}
    got = {(p, k): s for p, k, s in zip(*(x.tolist() for x in index.search(hashes, counts, skipped)), strict=True)}
    # Exhaustively, by the formula alone.
    n, mean = len(bench), sum(map(len, bench)) / len(bench)
    df = collections.Counter(w for t in bench for w in set(t))
    weight = lambda t, w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    flat = [w for t in texts for w in t]
    _, first, end = index.passages(counts)
    want = {}
    for p, (a, b) in enumerate(zip(first.tolist(), end.tolist(), strict=True)):
        held = set(flat[a:b])
        for k, t in enumerate(bench):
            share = sum(weight(t, w) for w in set(t) & held) / sum(weight(t, w) for w in set(t))
            if share >= index.share[k] + 1e-3:
                want[p, k] = share
            elif share < index.share[k] - 1e-3:
                assert (p, k) not in got
    assert want.keys() <= got.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert len(want) >= 40
    if vocabulary > 30:
        assert skipped["closed"] > 0 and skipped["scored"] < skipped["refined"] < skipped["bounded"] < skipped["all"]


def test_parts_of_the_benchmark_and_ids_of_any_type(spark):
    r = random.Random(11)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    bench = [((k, f"i{k}"), text(r.randrange(8, 30))) for k in range(40)] + [(None, text(12))]
    bench += [((99, "same"), bench[0][1])]
    texts = [text(30) + " " + bench[k][1] + " " + text(40) for k in (0, 5, 17, 40)] + [text(90), bench[5][1]] + [None]
    ids = [1, 2, 3, None, 5, 2, 7]
    b = spark.createDataFrame(bench, "item_id struct<a: int, b: string>, text string")
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(2)
    want = sorted(map(str, [(1, (0, "i0")), (1, (99, "same")), (2, (5, "i5")), (2, (5, "i5")), (3, (17, "i17")), (None, None)]))
    for shard_bytes, most in ((1 << 20, 1 << 20), (2000, 5000), (500, 1)):
        got = decontam.find_leaks(docs, b, shard_bytes=shard_bytes, most=most).collect()
        assert sorted(str((x["doc_id"], x["item_id"] and tuple(x["item_id"]))) for x in got) == want
        assert decontam.drop_leaks(docs, b, shard_bytes=shard_bytes, most=most).count() == 2


def test_leaks_in_very_long_and_repeated_documents(spark):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item = text(20)
    long = text(400_000)
    texts = [f"{long} {item} {long} {item}", item, item, f"{item} x {item}"]
    docs = spark.createDataFrame(list(zip([1, 2, 2, 3], texts, strict=True)), "doc_id long, text string")
    got = decontam.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["first_word"] > 0) for x in got) == [(1, True), (2, False), (2, False), (3, False)]
    assert all((x["score"], x["question_overlap"], x["answer_overlap"]) == (1, 1, 1) for x in got)


def test_leaks_of_whole_items_anywhere(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(i, text(r.randrange(6, 50)), "z") for i in range(300)] + [(900, None, "z"), (901, "", "z")]
    texts, want = [None, ""], set()
    for i in range(150):
        k = r.randrange(300)
        body = text(r.randrange(400))
        if i % 2:
            texts.append(body + "\n" + bench[k][1].upper() + ". " + text(r.randrange(300)))
            want.add((len(texts) - 1, bench[k][0]))
        else:
            texts.append(body + " " + " ".join(bench[k][1].split()[: len(bench[k][1].split()) // 2]))
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    docs = table(spark, texts)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, b).collect()} == want
    kept = decontam.drop_leaks(docs, b)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == docs.columns
    assert decontam.find_leaks(docs, b.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), b).count() == 0
    assert decontam.drop_leaks(docs, b.limit(0)).count() == docs.count()


def test_single_word_changes_at_every_place():
    r = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    # Few items share the words of the short ones, so one rare word carries much of their score.
    texts = [[r.choice(words[:12] if n < 20 else words) for _ in range(n)] for n in (9, 9, 10, 12, 14, 19, 24, 29, 34, 40, 47, 60) for _ in range(3)]
    for k, t in enumerate(texts[:18]):
        t[0] = f"rare{k}"
    index = index_of([" ".join(t) for t in texts])
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows_, want = [], set()
    for i, t in enumerate(texts):
        for at in range(len(t)):
            changed = [*t[:at], "changed", *t[at + 1 :]]
            if len(shingles(t) & shingles(changed)) >= 0.8 * len(shingles(t)):
                want.add((len(rows_), i))
            rows_.append(" ".join(["before"] * (at % 3) + changed + ["after"] * 5).encode())
    hashes, counts = decontam.words_of(np.frombuffer(b"".join(rows_), np.uint8), np.cumsum([0, *map(len, rows_)]))
    got = {(row, k) for row, k, *_ in index.leaks(hashes, counts)}
    assert len(want) > 500 and want <= got
    # An item with its own answer keeps the test of both parts.
    apart = index_of([" ".join(texts[-1][:45])], [" ".join(texts[-1][45:])])
    raw = " ".join([*texts[-1][:52], "changed", *texts[-1][53:]]).encode()
    hashes, counts = decontam.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert apart.leaks(hashes, counts) == []


# -- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as p

    from tests.llm.test_dedup import links

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(docs.limit(1).select(F.lit(20_000).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")).cache()
    one = p.STAGES[0][1](spark, docs, DATA).cache()
    assert one.count() == docs.count() - 1 and one.columns == docs.columns
    two = p.STAGES[1][1](spark, one, DATA).cache()
    rows_ = sorted((x["doc_id"], x["text"]) for x in one.collect())
    from fractions import Fraction

    roots = links([t for _, t in rows_], 5, Fraction(4, 5))
    assert sorted(x["doc_id"] for x in two.collect()) == sorted({rows_[r][0] for _, r in roots.values()})
    three = p.STAGES[2][1](spark, two, DATA).cache()
    bench = [x["text"] for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [x for x in three.collect() if any(b in x["text"] for b in bench)]
    four = p.STAGES[3][1](spark, three, DATA).cache()
    assert four.columns == docs.columns and {x["doc_id"] for x in four.collect()} <= {x["doc_id"] for x in three.collect()}
    five = p.STAGES[4][1](spark, four, DATA)
    assert five.count() == four.count()
    assert five.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == five.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_stages_decide_by_row(spark):
    import corpus_pipeline as p

    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    # Null ids with unrelated texts, a null-id copy of a document with an id, one id with two texts of which one is a copy.
    given = [(None, a), (None, b), (3, c), (None, c), (4, d), (5, d), (5, e), (None, "new " + a), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in given], "doc_id long, text string, source string, lang string").repartition(3)
    kept = p.near_duplicates(spark, docs, DATA)
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 7
    assert {(None, b), (3, c), (4, d), (5, e), (7, None), (7, "")} <= set(got) and sum(x in ((None, a), (None, "new " + a)) for x in got) == 1
    # Of rows that repeat an id each is taken as often as the mix says of it.
    sources = [("big", 3)] * 30 + [("small", 1)] * 30
    docs = spark.createDataFrame([(i % 3 or None, text(3 + i % 20), s) for i, (s, _) in enumerate(sources)], "doc_id long, text string, source string").repartition(3)
    want = sum(x["taken"] for x in mix_sources(docs).collect())
    mixed = p.mix(spark, docs, DATA)
    assert mixed.columns == docs.columns and sum(len(x["text"].split()) for x in mixed.collect()) == want
    # Order among rows that repeat an id does not depend on where they lie.
    again = p.mix(spark, docs.repartition(5, "text"), DATA)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in p.STAGES[:-1]:
        after = step(spark, docs, DATA)
        assert after.columns == docs.columns and after.count() == 0
    assert p.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_pipeline_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    import corpus_pipeline as p

    names = ["_row", "_dig", "_n", "_mix_copy", "_ROW_", "copies", "taken", "size", "score", "lang_pred", "id", "dig", "gram", "key0", "part", "leak", "batch"]
    words = "the of and to in is that for it was with as on be by this are from at an".split()
    texts = [" ".join(words[(i * 7 + k * (i + 1)) % len(words)] + ("x" * (k % 3)) for k in range(40)) for i in range(12)] + ["same words here " * 20] * 3
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, "a question that nobody asked and no answer to it either")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, step in p.STAGES[:-1]:
        out = step(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert p.tokens(spark, docs, f"file://{tmp_path}").count() == len(texts)
