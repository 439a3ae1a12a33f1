"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded: shares of character classes, word length,
novelty and repetition of its words, and a hashed bag of words go through a learnt layer. Gated attention (a tanh branch
times a sigmoid branch) gives each passage a weight, the weighted passage representation is scored, and all parts learn
together from document labels only.

The net is fitted on the driver on a bounded sample of labelled documents, PER_CLASS a class; classes weigh as in all the
labels. Repeated labels of a doc_id count once, and a doc_id that is labelled both ways is left out; rows that share a
labelled doc_id all take part. The sample and its order depend on nothing but the rows, so the net is the same at each run.

A null or empty text, or one without words, is a bag of one empty passage and is scored like any other. Each row is scored
by its own text, whatever its doc_id (null, or shared with other rows); further columns play no part. Without any label the
score is that of the net at its start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fold, keep_rows, labelled_sample, map_rows, table, words_of

PASSAGE, PER_CLASS = 64, 2000
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!", b"?", b"#*$%&", b"|<>", b"'\"()-", b"=_~^{}[]\\/@+`", bytes(range(128, 256)))
CLASS_OF = np.zeros(256, np.int64)
for _k, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _k + 1
BUCKETS = 24
N_CLASSES = len(CLASSES) + 1
DIMS = len(CLASSES) + 4 + BUCKETS
HIDDEN, ATTENTION = 20, 12


def encode(text: str | None, hashes: WordHashes) -> np.ndarray:
    """A row for each passage."""
    words = words_of(text)
    if not words:
        return np.zeros((1, DIMS), np.float32)
    data = np.frombuffer(b" ".join(words), np.uint8)
    n = len(words)
    m = -(-n // PASSAGE)
    gaps = np.flatnonzero(data == 32)
    starts = np.append(0, gaps[PASSAGE - 1 :: PASSAGE] + 1)[:m]
    size = np.diff(np.append(starts, len(data)))
    counts = np.bincount(np.repeat(np.arange(m) * N_CLASSES, size) + CLASS_OF[data], minlength=m * N_CLASSES).reshape(m, N_CLASSES)
    h = hashes.of(words)
    _, first, again = np.unique(h, return_index=True, return_inverse=True)
    new = np.zeros(n, np.int64)
    new[first] = 1
    row = np.arange(n) // PASSAGE
    per = np.bincount(row, minlength=m)
    same = np.bincount(row[1:], again[1:] == again[:-1], minlength=m)
    bag = np.bincount(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=m * BUCKETS).reshape(m, BUCKETS)
    chars = np.maximum(counts[:, 1:].sum(1), 1)
    out = np.empty((m, DIMS), np.float32)
    k = len(CLASSES)
    out[:, :k] = np.sqrt(counts[:, 1:] / chars[:, None])
    out[:, k] = np.minimum(chars / per / 8, 3)
    out[:, k + 1] = np.bincount(row, new, minlength=m) / per
    out[:, k + 2] = same / per
    out[:, k + 3] = per / PASSAGE
    out[:, k + 4 :] = np.sqrt(bag / per[:, None])
    return out


class AttentionNet:
    """Weights: encoder (w, b), attention (v, u, a), score (c, d)."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"w": g(DIMS, HIDDEN), "b": np.zeros(HIDDEN), "v": g(HIDDEN, ATTENTION), "u": g(HIDDEN, ATTENTION), "a": g(ATTENTION, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        e = (t * s) @ p["a"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        att = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(att[:, None] * h, starts)
        return h, t, s, att, size, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))

    def attention(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, np.array([0]))[3]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, att, size, z, score = self.forward(x, starts)
        dz_score = weight * (score - y) / weight.sum()
        dz = np.repeat(dz_score[:, None] * p["c"], size, axis=0)
        datt = (dz * h).sum(1)
        mean = np.add.reduceat(att * datt, starts)
        de = att * (datt - np.repeat(mean, size))
        dts = de[:, None] * p["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (att[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dz_score, "d": np.array([dz_score.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> "AttentionNet":
        r = np.random.default_rng(17)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs if len(bags) else 0):
            order = r.permutation(len(bags))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                x = np.concatenate([bags[i] for i in own]).astype(float)
                starts = np.append(0, np.cumsum([len(bags[i]) for i in own])[:-1])
                step += 1
                for k, g in self.gradients(x, starts, y[own], weight[own]).items():
                    g = g + decay * self.p[k] * (g.ndim > 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> AttentionNet:
    """The net from labelled rows outside the fold crc32(doc_id) mod 5 = 0."""

    def make():
        hashes = WordHashes()

        def run(rows):
            return {"doc_id": rows["doc_id"], "quality": rows["quality"], "weight": rows["weight"], "bag": [encode(t, hashes).tobytes() for t in rows["text"]]}

        return run

    sample = labelled_sample(docs, labels, F.coalesce(fold("doc_id", 5), F.lit(0)) != 0, per_class).select("doc_id", "text", "quality", "weight")
    rows = map_rows(sample, make, "doc_id long, quality int, weight double, bag binary").toPandas().sort_values(["doc_id", "bag"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, DIMS) for b in rows["bag"]]
    return AttentionNet().fit(bags, rows["quality"].to_numpy(float), rows["weight"].to_numpy(float))


def _scorer(net: AttentionNet):
    hashes = WordHashes()

    def score(texts: list) -> np.ndarray:
        bags = [encode(t, hashes) for t in texts]
        return net.score(np.concatenate(bags), np.append(0, np.cumsum([len(b) for b in bags])[:-1]))

    return score


def scored(docs: DataFrame, net: AttentionNet) -> DataFrame:
    """doc_id and score of every whole text."""

    def make():
        score = _scorer(net)
        return lambda rows: {"doc_id": rows["doc_id"], "score": score(rows["text"])}

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def accepted(docs: DataFrame, net: AttentionNet, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score at least so much."""

    def make():
        score = _scorer(net)
        return lambda texts: score(texts) >= least

    return keep_rows(docs, make)


def op1(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
