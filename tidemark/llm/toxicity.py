"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Every word enters as two vectors: one of its hash, and the mean of those of its character trigrams. The
network reads windows of ``STEPS`` words that overlap and together cover the whole text; attention pools the
states of a window, and a document scores as its highest window. Training knows documents only, so each
round trains on the window of every document that the network holds to be the most toxic.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, prefix_hash, ship, slices, span_hash, stage, word_spans

STEPS, STRIDE = 64, 48
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 12, 8, 8
#: Labelled documents of either class that training is expected to read.
SAMPLE = 2000
#: Rounds over the sample, more of them where it makes few batches; the best one by held-out documents counts.
ROUNDS, UPDATES, BATCH, RATE = 4, 160, 128, 0.01
CHUNK = 2048
RARE, DECAY = 8, 1e-4

# Words are runs of ASCII letters and digits and of anything beyond ASCII.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False


class Vocabulary:
    """The distinct words of a stretch of text: hash buckets, and trigram buckets in one row after another."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = LOWER[raw]
        starts, ends, self.counts = word_spans(low, offsets, GAP)
        hashes = span_hash(prefix_hash(low), starts, ends)
        distinct, first, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (distinct % np.uint64(WORDS)).astype(np.int64)
        a, b = starts[first], ends[first]
        size = b - a
        self.at = np.concatenate([[0], np.cumsum(size)])
        pos = np.arange(self.at[-1]) + np.repeat(a - self.at[:-1], size)
        left, mid, right = (low[np.clip(pos + d, 0, max(len(low) - 1, 0))].astype(np.int64) if len(low) else pos for d in (-1, 0, 1))
        left[self.at[:-1]] = 0
        right[self.at[1:] - 1] = 0
        self.gram = ((left * 257 + mid) * 263 + right) * 2654435761 % (1 << 32) >> 20

    def inputs(self, m: dict[str, np.ndarray], of: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of all distinct words, a zero row after the last."""
        if not len(self.bucket):
            return np.zeros((1, 2 * DIM), np.float32)
        chars = np.add.reduceat(m["chars"][self.gram], self.at[:-1]) / np.diff(self.at)[:, None].astype(np.float32)
        return np.concatenate([np.concatenate([m["words"][self.bucket], chars], axis=1), np.zeros((1, 2 * DIM), np.float32)])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window; the last one of a row ends with it."""
    n = np.where(counts <= STEPS, (counts > 0).astype(np.int64), 1 - (-(counts - STEPS) // STRIDE))
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(counts) - counts
    return base[row] + np.minimum(k * STRIDE, np.maximum(counts[row] - STEPS, 0)), row


def window_ids(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Word numbers of the windows, (windows, STEPS); ``pad`` after the end of a short one."""
    at = first[:, None] + np.arange(STEPS)
    inside = np.arange(STEPS) < size[:, None]
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)], pad)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def window_logits(m: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of windows (n, STEPS) of word numbers; both directions run side by side, features along the rows."""
    pad = len(x) - 1
    put = [(x @ m["in"][d] + m["bias"][d]).astype(np.float32) for d in (0, 1)]
    rec = np.zeros((6 * HIDDEN, 2 * HIDDEN), np.float32)
    for d in (0, 1):
        for g in range(3):
            rec[(2 * g + d) * HIDDEN : (2 * g + d + 1) * HIDDEN, d * HIDDEN : (d + 1) * HIDDEN] = m["rec"][d][:, g * HIDDEN : (g + 1) * HIDDEN].T
    out = np.empty(len(ids), np.float32)
    two = 2 * HIDDEN
    for i in range(0, len(ids), CHUNK):
        part = ids[i : i + CHUNK]
        n = len(part)
        real = (part != pad).astype(np.float32).T
        masked = not real.all()
        h = np.zeros((two, n), np.float32)
        kept = np.empty((STEPS, two, n), np.float32)
        g = np.empty((3, 2, HIDDEN, n), np.float32)
        for t in range(STEPS):
            for d, s in ((0, t), (1, STEPS - 1 - t)):
                g[:, d] = put[d][part[:, s]].T.reshape(3, HIDDEN, n)
            flat = g.reshape(6 * HIDDEN, n)
            a = rec @ h
            zr = flat[: 2 * two]
            zr += a[: 2 * two]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, c = flat[:two], flat[two : 2 * two], flat[2 * two :]
            r *= a[2 * two :]
            c += r
            np.tanh(c, out=c)
            new = c + z * (h - c)
            if masked:
                for d, s in ((0, t), (1, STEPS - 1 - t)):
                    rows = slice(d * HIDDEN, (d + 1) * HIDDEN)
                    new[rows] = np.where(real[s] > 0, new[rows], h[rows])
            h = new
            kept[t, :HIDDEN] = h[:HIDDEN]
            kept[STEPS - 1 - t, HIDDEN:] = h[HIDDEN:]
        score = np.einsum("thn,h->tn", kept, m["attend"])
        if masked:
            score = np.where(real > 0, score, -1e9)
        score = np.exp(score - score.max(axis=0))
        value = np.einsum("thn,h->tn", kept, m["out"])
        out[i : i + n] = (score * value).sum(axis=0) / score.sum(axis=0) + m["base"][0]
    return out


def document_scores(m: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray, prior: float) -> tuple[np.ndarray, Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    vocabulary = Vocabulary(raw, offsets)
    first, row = windows(vocabulary.counts)
    score = np.full(len(offsets) - 1, prior, np.float64)
    logits = np.zeros(0, np.float32)
    if len(first):
        x = vocabulary.inputs(m)
        size = np.minimum(vocabulary.counts[row], STEPS)
        logits = np.empty(len(first), np.float32)
        for some in (np.flatnonzero(size == STEPS), np.flatnonzero(size < STEPS)):
            for i in range(0, len(some), CHUNK):
                k = some[i : i + CHUNK]
                logits[k] = window_logits(m, x, window_ids(vocabulary.ids, first[k], size[k], len(x) - 1))
        start = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        score[row[start]] = 1 / (1 + np.exp(-np.maximum.reduceat(logits, start).astype(np.float64)))
    return score, vocabulary, first, row, logits


def start_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return {
        "words": f(WORDS, DIM, scale=0.1), "chars": f(GRAMS, DIM, scale=0.1),
        "in": f(2, 2 * DIM, 3 * HIDDEN, scale=0.25), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "rec": f(2, HIDDEN, 3 * HIDDEN, scale=0.25),
        "attend": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "base": np.zeros(1, np.float32),
    }


def gradients(m: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of windows and its gradients, back through time."""
    x_all = v.inputs(m)
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    x, pad = x_all[used], len(x_all) - 1
    real = (ids != pad).astype(np.float32)
    n = len(ids)
    H = HIDDEN
    states, memo = np.zeros((STEPS, n, 2 * H), np.float32), [[], []]
    for d in (0, 1):
        put, h, rec = x @ m["in"][d] + m["bias"][d], np.zeros((n, H), np.float32), m["rec"][d]
        for t in range(STEPS) if d == 0 else range(STEPS - 1, -1, -1):
            p, a, k = put[at[:, t]], h @ rec, real[:, t : t + 1]
            z, r = _sigmoid(p[:, :H] + a[:, :H]), _sigmoid(p[:, H : 2 * H] + a[:, H : 2 * H])
            c = np.tanh(p[:, 2 * H :] + r * a[:, 2 * H :])
            new = k * (c + z * (h - c)) + (1 - k) * h
            memo[d].append((t, h, z, r, c, a[:, 2 * H :], k))
            h = new
            states[t, :, d * H : (d + 1) * H] = h
    score = states @ m["attend"] - 1e9 * (1 - real.T)
    alpha = np.exp(score - score.max(axis=0))
    alpha /= alpha.sum(axis=0)
    value = states @ m["out"]
    logit = (alpha * value).sum(axis=0) + m["base"][0]
    p = _sigmoid(logit)
    loss = float(-(weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum())
    dl = (weight * (p - label)).astype(np.float32)
    dvalue = alpha * dl
    dscore = alpha * (value - (alpha * value).sum(axis=0)) * dl
    g = {"base": np.array([dl.sum()], np.float32), "out": np.einsum("tn,tnh->h", dvalue, states), "attend": np.einsum("tn,tnh->h", dscore, states)}
    dstates = dvalue[:, :, None] * m["out"] + dscore[:, :, None] * m["attend"]
    dx = np.zeros_like(x)
    g["in"], g["bias"], g["rec"] = (np.zeros_like(m[k]) for k in ("in", "bias", "rec"))
    for d in (0, 1):
        rec, dput, dh = m["rec"][d], np.zeros((len(x), 3 * H), np.float32), np.zeros((n, H), np.float32)
        for t, h, z, r, c, ac, k in reversed(memo[d]):
            dn = dh + dstates[t, :, d * H : (d + 1) * H]
            now = dn * k
            dc = now * (1 - z) * (1 - c * c)
            dz = now * (h - c) * z * (1 - z)
            dr = dc * ac * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(dput, at[:, t], np.concatenate([dz, dr, dc], axis=1))
            g["rec"][d] += h.T @ da
            dh = now * z + dn * (1 - k) + da @ rec.T
        g["in"][d], g["bias"][d] = x.T @ dput, dput.sum(axis=0)
        dx += dput @ m["in"][d].T
    g["words"], g["chars"] = np.zeros_like(m["words"]), np.zeros_like(m["chars"])
    live = used != pad
    w, dx = used[live], dx[live]
    np.add.at(g["words"], v.bucket[w], dx[:, :DIM])
    size = np.diff(v.at)[w]
    per = np.repeat(dx[:, DIM:] / size[:, None], size, axis=0)
    grams = v.gram[np.arange(size.sum()) + np.repeat(v.at[w] - (np.cumsum(size) - size), size)]
    np.add.at(g["chars"], grams, per)
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, share: float | None = None) -> dict[str, np.ndarray]:
    """Fit a model to documents and their labels; with one class or none it scores all alike.

    ``share`` is that of label 1 among all documents, where the sample has another.
    """
    rng = np.random.default_rng(seed)
    m = start_model(rng)
    share = float(np.clip(share if share is not None else labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    m["prior"] = np.array([share])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    v = Vocabulary(raw, offsets)
    first, row = windows(v.counts)
    if not len(first) or len(set(labels.tolist())) < 2:
        m["out"][:] = 0
        m["base"][0] = np.log(share / (1 - share))
        return m
    # Where to begin: how much oftener documents of label 1 hold a word sets one of its inputs.
    doc = np.repeat(np.arange(len(texts)), v.counts)
    pair = np.unique(doc * len(v.bucket) + v.ids)
    word, toxic = v.bucket[pair % len(v.bucket)], labels[pair // len(v.bucket)]
    pos, neg = np.bincount(word[toxic == 1], minlength=WORDS), np.bincount(word[toxic == 0], minlength=WORDS)
    ratio = max((labels == 0).sum(), 1) / max((labels == 1).sum(), 1)
    # Words that few documents hold would be learned by heart: they enter by their characters alone.
    rare = pos + neg < RARE
    m["words"][:, 0] = np.clip(np.log((pos * ratio + 2) / (neg + 2)), -2, 4) / 2
    m["words"][rare] = 0
    size = np.minimum(v.counts[row], STEPS)
    lead = m["words"][v.bucket, 0]
    padded = np.concatenate([lead, [-9]])
    ids = window_ids(v.ids, first, size, len(v.bucket))
    best = padded[ids].max(axis=1)
    start = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
    docs = row[start]
    label = labels[docs].astype(np.float32)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)).astype(np.float32)
    moment = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in m.items() if k != "prior"}
    step, kept = 0, None
    # Every fifth document is left to tell after which round to stop.
    check = np.arange(len(start)) % 5 == 4
    rounds = min(max(ROUNDS, -(-UPDATES * BATCH // len(docs))), 60)
    for turn in range(rounds + 1):
        if turn:
            x = v.inputs(m)
            best = np.concatenate([window_logits(m, x, ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)])
            high = np.maximum.reduceat(best, start)
            # Log loss at a cap, as some labels are wrong whatever the text says.
            loss = float((weight * np.minimum(np.log1p(np.exp(np.where(label == 1, -high, high))), 2))[check].mean()) if check.any() else -turn
            if kept is None or loss < kept[0]:
                kept = (loss, {k: a.copy() for k, a in m.items()})
            if turn == rounds:
                break
        # The highest window of each document; for documents of label 0 also one at random.
        top = np.array([s + int(np.argmax(best[s:e])) for s, e in zip(start, [*start[1:], len(row)], strict=True)])
        top, learn = top[~check], ~check
        other = start + (rng.random(len(start)) * np.diff([*start, len(row)])).astype(np.int64)
        zero = learn & (label == 0)
        some = np.concatenate([top, other[zero]])
        y, w = np.concatenate([label[learn], label[zero]]), np.concatenate([weight[learn], 0.5 * weight[zero]])
        for k in np.array_split(rng.permutation(len(some)), -(-len(some) // BATCH)):
            _, g = gradients(m, v, ids[some[k]], y[k], w[k] / len(k))
            g["words"][rare] = 0
            g["chars"] += DECAY * m["chars"]
            step += 1
            for name, grad in g.items():
                one, two = moment[name]
                one += 0.1 * (grad - one)
                two += 0.01 * (grad * grad - two)
                m[name] -= (RATE * (0.5 if turn >= rounds - 2 else 1) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    m = kept[1]
    # Windows were weighted as if both labels were equally frequent; the share of label 1 comes back in.
    m["base"][0] += np.float32(np.log(share / (1 - share)))
    return m


def _fit(seed: int, share: float):
    def run(batches):
        rows = sorted((bytes(t or b""), int(y)) for b in batches for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True))
        model = train([t for t, _ in rows], np.array([y for _, y in rows], np.int64), seed, share)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, seed: int = 7) -> dict[str, np.ndarray]:
    """Train on labelled documents; ``sample`` of either class are expected to be read, chosen by a hash of the id.

    Labels other than 0 and 1, null labels and null ids are left out; an id labelled twice has its larger label.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 20))
    some = known.where(F.when(F.col("y") == 1, h < (sample << 20) // max(counts.get(1, 0), 1) + 1).otherwise(h < (sample << 20) // max(counts.get(0, 0), 1) + 1))
    # Twice `sample` ids or so: few enough to broadcast, and for one task to train on.
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(some), "id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int"))
    model = stage(chosen.repartition(1).mapInArrow(_fit(seed, share), "model binary"), "model").first()
    return pickle.loads(model["model"]) if model else train([], np.zeros(0, np.int64), seed)


def _scores(model: dict[str, np.ndarray]):
    def run(batches):
        for rows, raw, offsets in slices(batches, "text"):
            score = document_scores(model, raw, offsets, float(model["prior"][0]))[0]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.clip(score, 0, 1))], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 from 0.5 on).

    A null text, or one without a word, scores as the share of label 1 among the documents learned from.
    Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    scored = rows.mapInArrow(_scores(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
