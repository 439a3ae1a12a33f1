"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Trees are fitted on the driver on a bounded sample of labelled documents (PER_CLASS a class): second-order boosting on
binned statistics, with monotonic constraints on chosen features kept by refusing splits whose leaves are out of order
and by passing the middle of such a split down as a bound. The forest is flattened into numpy node arrays, and all rows
of a batch walk down together.

Null and empty texts have no words; they fail the base rules. Repeated labels of a doc_id count once, and a doc_id that is
labelled both ways is left out, so that the trees are the same at each run. Each row is judged by its own text, whatever
its doc_id. Without any label all that pass the base rules are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fold, labelled_sample, map_rows, table, window_hashes, words_of

PER_CLASS = 2500
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct", "n_marks")
# name, direction of the constraint on P(quality = 1): 1 rises, -1 falls, 0 free
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbols_per_word", -1), ("dup_lines", -1), ("repeats", -1), ("upper", -1), ("digits", 0), ("distinct", 0), ("marks_per_word", -1), ("words_per_line", 0))


def statistics(text: str | None, hashes: WordHashes) -> list[int]:
    words = words_of(text)
    if not words:
        return [0] * len(STATS)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    h = hashes.of(words)
    w = window_hashes(h, 8)
    repeated = 0
    if len(w):
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int32)
        at = np.flatnonzero(twice)
        edge[at] += 1
        edge[at + 8] -= 1
        repeated = int(np.count_nonzero(np.cumsum(edge)[:-1] > 0))
    return [len(words), chars, count(b"#*$%&|<>"), dup, repeated, lines, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789"), len(set(words)), count(b"!?=_~^{}[]\\/@")]


def features(stats: np.ndarray) -> np.ndarray:
    n, chars, sym, dup, rep, lines, up, dig, distinct, marks = stats.T.astype(float)
    m = np.maximum(n, 1)
    c = np.maximum(chars, 1)
    return np.stack([np.log1p(n), chars / m, sym / m, dup / np.maximum(lines, 1), rep / m, up / c, dig / c, distinct / m, marks / m, n / np.maximum(lines, 1)], axis=1)


@dataclass
class Forest:
    """Flat nodes of all trees: inner nodes have feature, cut and the left child (the right one follows it); leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows[inner], f[inner]] > self.cut[at[inner]]
                at[inner] = self.left[at[inner]] + go
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 5.0) -> Forest:
    if not len(y):
        return Forest(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1), np.array([0]), 2.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip((weight * y).sum() / weight.sum(), 0.02, 0.98)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0])
        todo = [(roots[-1], np.arange(len(y)), 0, -3.0, 3.0)]
        while todo:
            node, rows, level, lo, hi = todo.pop()
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
            best = (1e-6, None)
            if level < depth:
                all_g, all_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    gr, hr = all_g - gl, all_h - hl
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2 + gr * vr + (hr + ridge) * vr**2 / 2) + (all_g * value + (all_h + ridge) * value**2 / 2)
                    gain[(hl < least / 4) | (hr < least / 4) | (signs[j] * (vr - vl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                nodes[node][3] = rate * value
                raw[rows] += rate * value
                continue
            j, k, vl, vr = best[1]
            child = len(nodes)
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            nodes[node][:3] = [j, cuts[j][k], child]
            mid = (vl + vr) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[j]]
            right = binned[rows, j] > k
            todo += [(child, rows[~right], level + 1, *bounds[0]), (child + 1, rows[right], level + 1, *bounds[1])]
    flat = np.array(nodes, float)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3], np.array(roots), base)


def described(docs: DataFrame, more: str = "") -> DataFrame:
    """doc_id, the statistics and further columns of docs."""

    def make():
        hashes = WordHashes()

        def run(rows):
            got = np.array([statistics(t, hashes) for t in rows["text"]], np.int64).reshape(-1, len(STATS))
            return {k: v for k, v in rows.items() if k != "text"} | {s: got[:, k] for k, s in enumerate(STATS)}

        return run

    rest = [c for c in more.split() if c]
    types = dict(docs.dtypes)
    return map_rows(docs.select("doc_id", "text", *rest), make, ", ".join(["doc_id long", *[f"{c} {types[c]}" for c in rest], *[f"{s} long" for s in STATS]]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """Trees from labelled rows outside the fold crc32(doc_id) mod 5 = 0; classes weigh as in all the labels."""
    rows = described(labelled_sample(docs, labels, F.coalesce(fold("doc_id", 5), F.lit(0)) != 0, per_class), "quality weight").toPandas().sort_values(["doc_id", *STATS])
    y = rows["quality"].to_numpy(float)
    return boost(features(rows[list(STATS)].to_numpy()), y, rows["weight"].to_numpy(), [s for _, s in FEATURES])


def judge(docs: DataFrame, forest: Forest, keep: float = 0.3) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every whole text."""

    def make():
        hashes = WordHashes()

        def run(rows):
            got = np.array([statistics(t, hashes) for t in rows["text"]], np.int64)
            failed = (got[:, 0] < 20) | (100 * got[:, 4] > 30 * got[:, 0])
            score = forest.score(features(got))
            return {"doc_id": rows["doc_id"], "base_failed": failed, "score": score, "kept": ~failed & (score >= keep)} | {s: got[:, k] for k, s in enumerate(STATS)}

        return run

    return map_rows(docs.select("doc_id", "text"), make, ", ".join(["doc_id long", *[f"{s} long" for s in STATS[:5]], "base_failed boolean", "score double", "kept boolean"]))


def op6(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
