"""License scans: ordered signature rules behind a keyword prefilter.

Texts become words (A-Z lower-cased; everything ASCII but letters and digits parts them) joined by single
spaces. A text without any of the keywords runs no expression. Rules are tried in order. A detection that lies
within another's interval is suppressed in favour of the longer, or at equal length of the rule with the higher
priority; of two that overlap in part the one of the higher priority stays, then the longer, then the earlier.
Base phrases are found always and their labels stay.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ship, slices
from tidemark.llm.license_texts import TEXTS, pattern

#: Phrases and labels whose places are counted.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Signature(NamedTuple):
    label: str
    priority: int
    pattern: str
    score: float
    keywords: tuple[str, ...]


# Names by which texts call a license (as words of the normalised text), a label, and words one of which any match holds.
_NAMES = (
    (r"gnu affero general public license|gnu agpl|agpl", "agpl", ("affero", "agpl")),
    (r"gnu (?:lesser|library) general public license|gnu lgpl|lgpl", "lgpl", ("lesser", "library", "lgpl")),
    (r"gnu free documentation license|gfdl", "gfdl", ("documentation", "gfdl")),
    (r"gnu general public license|gnu gpl|gpl", "gpl", ("gpl", "gnu")),
    (r"apache license|apache software license|apache", "apache", ("apache",)),
    (r"mit license|expat license|mit x11 license", "mit", ("mit", "expat")),
    (r"(?:modified |new |revised |simplified )?bsd(?: (?:2|3|4) clause)?(?: license)?", "bsd", ("bsd",)),
    (r"mozilla public license|mpl", "mpl", ("mozilla", "mpl")),
    (r"eclipse public license|epl", "epl", ("eclipse", "epl")),
    (r"eclipse distribution license", "edl", ("eclipse",)),
    (r"common development and distribution license|cddl", "cddl", ("cddl", "common")),
    (r"common public license", "cpl", ("common",)),
    (r"isc license", "isc", ("isc",)),
    (r"boost software license", "boost", ("boost",)),
    (r"zlib license|zlib libpng license", "zlib", ("zlib",)),
    (r"artistic license", "artistic", ("artistic",)),
    (r"python software foundation license|psf license", "psf", ("python", "psf")),
    (r"academic free license", "afl", ("academic",)),
    (r"open software license", "osl", ("open",)),
    (r"european union public licen[cs]e|eupl", "eupl", ("european", "eupl")),
    (r"microsoft public license", "ms-pl", ("microsoft",)),
    (r"microsoft reciprocal license", "ms-rl", ("microsoft",)),
    (r"server side public license|sspl", "sspl", ("server", "sspl")),
    (r"business source license", "bsl", ("business",)),
    (r"elastic license", "elastic", ("elastic",)),
    (r"open font license|sil open font license|ofl", "ofl", ("font", "ofl")),
    (r"open data commons attribution license|odc by", "odc-by", ("commons", "odc")),
    (r"open database license|odbl", "odbl", ("database", "odbl")),
    (r"creative commons attribution noncommercial noderivatives|cc by nc nd", "cc-by-nc-nd", ("creative", "cc")),
    (r"creative commons attribution noncommercial sharealike|cc by nc sa", "cc-by-nc-sa", ("creative", "cc")),
    (r"creative commons attribution (?:non commercial|noncommercial)|cc by nc", "cc-by-nc", ("creative", "cc")),
    (r"creative commons attribution noderivatives|cc by nd", "cc-by-nd", ("creative", "cc")),
    (r"creative commons attribution share ?alike|cc by sa", "cc-by-sa", ("creative", "cc")),
    (r"creative commons attribution|cc by", "cc-by", ("creative", "cc")),
    (r"creative commons zero|cc0", "cc0", ("creative", "cc0")),
    (r"unlicense", "unlicense", ("unlicense",)),
    (r"do what the fuck you want to public license|wtfpl", "wtfpl", ("wtfpl", "want")),
    (r"postgresql license", "postgresql", ("postgresql",)),
    (r"php license", "php", ("php",)),
    (r"ruby license", "ruby", ("ruby",)),
    (r"openssl license", "openssl", ("openssl",)),
    (r"cecill(?: [abc])?(?: license)?", "cecill", ("cecill",)),
    (r"q public license", "qpl", ("q",)),
    (r"university of illinois ncsa open source license|ncsa license", "ncsa", ("ncsa",)),
)
# The public short identifiers of licenses, as words of the normalised text.
_SPDX = {
    "agpl": r"agpl [13] 0", "lgpl": r"lgpl (?:2 [01]|3 0)", "gfdl": r"gfdl 1 [123]", "gpl": r"gpl [123] 0", "apache": r"apache (?:1 [01]|2 0)", "mit": r"mit(?: 0)?", "bsd": r"(?:0bsd|bsd [1234] clause)",
    "mpl": r"mpl (?:1 [01]|2 0)", "epl": r"epl [12] 0", "cddl": r"cddl 1 [01]", "cpl": r"cpl 1 0", "isc": r"isc", "boost": r"bsl 1 0", "zlib": r"zlib", "artistic": r"artistic [12] 0", "psf": r"(?:psf|python) 2 0",
    "afl": r"afl (?:1 [12]|2 [01]|3 0)", "osl": r"osl (?:1 0|2 [01]|3 0)", "eupl": r"eupl 1 [012]", "ms-pl": r"ms pl", "ms-rl": r"ms rl", "sspl": r"sspl 1 0", "bsl": r"busl 1 1", "elastic": r"elastic 2 0", "ofl": r"ofl 1 [01]",
    "odc-by": r"odc by 1 0", "odbl": r"odbl 1 0", "cc-by-nc-nd": r"cc by nc nd [1234] [05]", "cc-by-nc-sa": r"cc by nc sa [1234] [05]", "cc-by-nc": r"cc by nc [1234] [05]", "cc-by-nd": r"cc by nd [1234] [05]",
    "cc-by-sa": r"cc by sa [1234] [05]", "cc-by": r"cc by [1234] [05]", "cc0": r"cc0 1 0", "unlicense": r"unlicense", "wtfpl": r"wtfpl", "postgresql": r"postgresql", "php": r"php 3 0(?:1)?", "ruby": r"ruby", "openssl": r"openssl",
    "cecill": r"cecill (?:1 [01]|2 [01]|b|c)", "qpl": r"qpl 1 0", "ncsa": r"ncsa",
}
_VERSION = r"(?: (?:version|v|ver))? v?\d+(?: \d+)*"
# (form, priority, score): the more a form says, the higher.
_FORMS = (
    (r"spdx license identifier (?:{n})(?:{v})?(?: (?:only|or later))?", 90, 1.0),
    (r"(?:licensed|released|distributed|published|available|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:{n})(?:{v})?(?: (?:or|and) (?:any )?later(?: version)?)?", 80, 0.95),
    (r"subject to (?:the )?(?:terms of )?(?:the )?(?:{n})(?:{v})?", 70, 0.9),
    (r"(?:{n}){v}(?: (?:only|or later))?", 60, 0.8),
    (r"(?:see|read) (?:the )?(?:{n})(?: for)?(?: more)?(?: details)?", 50, 0.7),
)
_MORE = (
    Signature("mit", 75, r"permission is hereby granted free of charge to any person obtaining a copy", 1.0, ("permission",)),
    Signature("bsd", 75, r"redistribution and use in source and binary forms with or without modification are permitted", 1.0, ("redistribution",)),
    Signature("isc", 75, r"permission to use copy modify and or distribute this software for any purpose", 1.0, ("permission",)),
    Signature("gpl", 75, r"either version \d+ of the license or at your option any later version", 0.8, ("version",)),
    Signature("public-domain", 65, r"(?:released|dedicated|placed) (?:in)?to the public domain", 0.9, ("domain",)),
    Signature("proprietary", 40, r"all rights reserved", 0.5, ("reserved",)),
    Signature("proprietary", 45, r"proprietary and confidential", 0.8, ("proprietary",)),
)


def _long_names(names: str) -> str:
    """The alternatives of several words, which can stand for a license without more said."""
    return "|".join(a for a in re.split(r"\|(?![^(]*\))", names) if " " in re.sub(r"\(\?:[^)]*\)\??", "", a).strip())


#: The signature rules, in order of trial.
SIGNATURES = tuple(
    sorted(
        [Signature(label, p, form.format(n=n, v=_VERSION), s, words) for n, label, words in _NAMES for form, p, s in _FORMS]
        + [Signature(label, 95, rf"spdx license identifier (?:{id})(?: (?:only|or later))?", 1.0, ("spdx",)) for label, id in _SPDX.items()]
        + [Signature(label, 30, _long_names(n), 0.4, words) for n, label, words in _NAMES if _long_names(n)]
        # Of sentences of one text the longer one counts where both match, as everywhere.
        + [Signature(label, 75, pattern(sentence), 0.9, (word,)) for label, word, sentence in TEXTS]
        + list(_MORE),
        key=lambda s: (-s.priority, s.label),
    )
)

# Bytes that part words become spaces; A-Z become a-z.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Scanner:
    """``scan(text bytes)``: a row for one text."""

    def __init__(self, signatures=SIGNATURES, base=BASE):
        self.base = [(f" {p} ".encode(), label) for p, label in base]
        # Lookarounds hold matches to whole words, and are not part of the interval.
        self.rules = [(i, s, re.compile(rf"(?<= )(?:{s.pattern})(?= )".encode())) for i, s in enumerate(signatures)]
        by: dict[bytes, set[int]] = {}
        for i, s in enumerate(signatures):
            for k in s.keywords:
                by.setdefault(k.encode(), set()).add(i)
        self.by_keyword = by
        self.gate = by.keys() | {p.split()[0].encode() for p, _ in base}

    def detections(self, line: bytes, words: set[bytes]) -> list[tuple[int, int, Signature]]:
        due = sorted({i for k in self.by_keyword.keys() & words for i in self.by_keyword[k]})
        found = [(m.start(), m.end(), i) for i in due for m in self.rules[i][2].finditer(line)]
        # Longest first, then the higher priority: what lies within an earlier interval is suppressed.
        left: list[tuple[int, int, int]] = []
        reach = -1
        for a, b, i in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
            if b > reach:
                left.append((a, b, i))
                reach = b
        # What is left starts and ends in the same order; rules are numbered from the highest priority on.
        kept: list[tuple[int, int, int]] = []
        for a, b, i in sorted(left, key=lambda f: (-self.rules[f[2]][1].priority, f[0] - f[1], f[0])):
            at = bisect.bisect(kept, (a,))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, i))
        return [(a, b, self.rules[i][1]) for a, b, i in kept]

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = raw.translate(_TABLE).split()
        distinct = set(words)
        if not distinct & self.gate:
            return len(words), 0, None, None, "", "", 0.0
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        kept = self.detections(line, distinct)
        labels = base | {s.label for _, _, s in kept}
        doubt = 1.0
        for p in [s.score for _, _, s in kept] + [0.6] * bool(places):
            doubt *= 1 - p
        first, last = (line.count(b" ", 0, min(places)), line.count(b" ", 0, max(places))) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6)


def _scan(id_col: str, signatures, base, id_type: pa.DataType | None = None):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        scanner = Scanner(signatures, base)
        for rows, raw, offsets in slices(batches, "text"):
            data = raw.tobytes()
            out = [scanner.scan(data[offsets[i] : offsets[i + 1]]) for i in range(rows.num_rows)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[id_col, *names])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures=SIGNATURES, base=BASE) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places where the words of a base phrase stand one after another, first_word and
    last_word are the smallest and largest word at which one starts (else null). labels are those of the
    detections that remain and of the base phrases, distinct, sorted, joined by commas. score is one minus
    the product of what each remaining detection leaves in doubt. Null or empty text has no words, labels
    or score; rows that repeat stay repeated; an empty table gives an empty result; other columns are
    ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = rows.mapInArrow(_scan("id", signatures, base), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return found.withColumnRenamed("id", id_col)
