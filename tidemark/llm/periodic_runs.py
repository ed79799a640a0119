"""Stretches of words that repeat with a period, found for all lags with bit-parallel comparisons.

The words of a few texts stand in a row as numbers, and every binary digit of these is one big integer, a bit a word. For
a lag q the planes are shifted by q and XORed, and what differs in any plane is ORed: zeros are words that recur q words
on. Ones of the complement are ANDed with themselves at doubling shifts, which leaves those that begin a stretch of the
least length, for most lags none. Texts of like length share a row, as a step on a few thousand bits costs what one on
a few hundred does; a mask keeps lags within their text. Each lag looks at each word of the row once, so a text of n
words takes n / 2 steps of n / 64 machine words, and no more memory than its planes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship

#: Words of a row of several texts.
ROW_WORDS = 1 << 14
#: Planes that are compared before the first look for stretches.
FIRST = 3
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _stretches(x: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of ones among the lowest n bits."""
    raw = np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8)
    step = np.diff(np.unpackbits(raw, count=n, bitorder="little").astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(step == 1)
    return starts, np.flatnonzero(step == -1) - starts


def _at_least(x: int, m: int) -> int:
    """Ones where a stretch of m ones of ``x`` begins; gives up at once when there is none."""
    have = 1
    while x and have < m:
        by = min(have, m - have)
        x &= x >> by
        have += by
    return x


def runs_of(texts: list[list], least: int = 12, turns: int = 2) -> list[list[tuple[int, int, int]]]:
    """For each list of words: (start, length, period) of its runs, ordered by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    n = int(edges[-1])
    longest = int(lengths.max(initial=0)) // turns if len(texts) else 0
    if max(lengths, default=0) < least:
        return found
    ids: dict = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.uint32, n)
    planes = [_bits(numbers >> b & 1) for b in range(max((len(ids) - 1).bit_length(), 1))]
    first, rest = planes[:FIRST], planes[FIRST:]
    inner = np.ones(n, np.uint8)
    inner[edges[1:][lengths > 0] - 1] = 0
    after = _bits(inner)  # words whose next word is of the same text
    within = (1 << n) - 1
    for q in range(1, longest + 1):
        within &= after >> (q - 1)
        # A run of length L is L - q words that recur q words on.
        m = max(least - q, (turns - 1) * q)
        differ = 0
        for p in first:
            differ |= p ^ (p >> q)
        x = _at_least(within & ~differ, m)
        if not x:
            continue
        for p in rest:
            differ |= p ^ (p >> q)
        x = _at_least(within & ~differ, m)
        if not x:
            continue
        for start, count in zip(*map(np.ndarray.tolist, _stretches(x, n)), strict=True):
            at = int(np.searchsorted(edges, start, "right")) - 1
            begin, length = start - int(edges[at]), count - 1 + m + q
            # A stretch with a smaller period p has one that divides q, as it is twice as long; its run was found before and holds it.
            if not any(q % p == 0 and b <= begin and begin + length <= b + k for b, k, p in found[at]):
                found[at].append((begin, length, q))
    for r in found:
        r.sort(key=lambda run: (run[0], run[2]))
    return found


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The row of one text: number of runs, the longest, and digests of all of them and of the words without repeats."""
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    text = b" ".join([w for w, k in zip(words, keep, strict=True) if k] if runs else words)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def _rows(lengths: list[int], limit: int) -> Iterator[list[int]]:
    """Texts dealt to rows of like length, each of at most ``limit`` words (or one text)."""
    row: list[int] = []
    held = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if row and held + lengths[i] > limit:
            yield row
            row, held = [], 0
        row.append(i)
        held += lengths[i]
    if row:
        yield row


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """Of every tenth document by the CRC-32 of its id, words from a place on repeat those that stand there."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, turns: int = 2, plant: bool = False) -> DataFrame:
    """A row per document: the id, ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``; ties: least start, then period), ``runs_sha256`` and ``collapsed_sha256``.

    A run is a stretch of words of smallest period q, at least ``least`` and ``turns`` * q words long (two turns or more),
    that neither neighbour extends. The collapsed text drops what follows a run's first q words within it. With ``plant``
    the words of some documents are first made periodic (``planted``; a null id never is).

    Null and empty texts have no words: no run, four nulls, digests of nothing. Every row is judged by itself, so that ids
    may be null or repeat, and copies get equal rows; an empty table gives none; other columns are not read. A text is
    compared whole, however long; one of n words takes time in proportion to n squared / 128.
    """
    if turns < 2 or least < 1:
        raise ValueError("a run turns at least twice")
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            words = [planted((t.as_py() or b"").split(), i.as_py()) if plant else (t.as_py() or b"").split() for i, t in zip(ids, texts, strict=True)]
            out: list = [None] * len(words)
            for row in _rows([len(w) for w in words], ROW_WORDS):
                for i, runs in zip(row, runs_of([words[i] for i in row], least, turns), strict=True):
                    out[i] = digest(words[i], runs)
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)]], names=[id_col, *names])

    few = docs.select(F.col(id_col), F.col(text_col))
    return few.mapInArrow(run, f"`{id_col}` {few.schema[0].dataType.simpleString()}, {SCHEMA}")


#: A stretch of 12 words and two turns has six words in a row that recur q words on, so that pairs of equal strings of six words find them all.
ORACLE = r"""
WITH RECURSIVE bit(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM bit WHERE n < 7),
-- CRC-32 of a byte, bit by bit, and of the decimal digits of the ids.
crc_step(b, k, c) AS (SELECT b, 0, b::UBIGINT FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_of AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8),
raw AS (SELECT doc_id, row_number() OVER () AS r, doc_id::VARCHAR AS digits, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(digits, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM raw, crc_of WHERE digits IS NOT NULL),
p AS (SELECT raw.r, doc_id, words, len(words) AS n, coalesce(h, 1) AS h, h // 10 AS g FROM raw LEFT JOIN crc USING (r)),
q AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM p),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN words[:a] || list_transform(range(n - a), lambda i: words[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE words END AS words FROM q),
grams AS MATERIALIZED (SELECT r, i, array_to_string(words[i + 1:i + 6], ' ') AS s FROM (SELECT r, words, unnest(range(n - 5)) AS i FROM d WHERE n >= 12)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
cut AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
spans AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM cut GROUP BY r, q, island),
long AS MATERIALIZED (SELECT * FROM spans WHERE length >= 12 AND length >= 2 * q),
runs AS MATERIALIZED (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
best AS (SELECT r, count(*) AS n_runs, max({'length': length, 'start': -start, 'period': -q}) AS b, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT k.r, string_agg(w, ' ' ORDER BY k.i) AS text FROM (SELECT r, unnest(words) AS w, unnest(range(n)) AS i FROM d) k ANTI JOIN gone ON k.r = gone.r AND k.i = gone.i GROUP BY k.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -b.start AS start, b.length AS length, -b.period AS period, 1000 * b.length // -b.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
