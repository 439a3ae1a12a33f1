"""Language identification, words first.

A known word is scored by its logarithmic frequency in each language, with a penalty where a language lacks it. A word
that no language knows is scored by the mean over its character n-grams (word edges included) of the longest length of
which any n-gram is known, from LONGEST down to 1. A text's score is the mean over its words.

Frequencies come from a bounded sample of documents (PER_LANG a language); all words and n-grams of the sample are kept, as
sorted 64-bit hashes with a row of scores each. Words are runs of letters in lower case.

Texts that are null or have no letter are `und` with score 0, as is all if there is nothing to learn from. Of languages with
the same score the least name wins. Each row is predicted by its own text, whatever its doc_id; repeated rows count as often
as they are there; further columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_rows, mix, odd_constants, table

PER_LANG, LONGEST, PENALTY = 1000, 5, 1.5
LETTERS = re.compile(r"[^\W\d_]+")
SHARPNESS = 4.0
KEEP = 200_000


def words_in(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Scores:
    """Rows of scores, one for each language, of hashed items."""

    def __init__(self, items: np.ndarray, lang: np.ndarray, n: np.ndarray, n_langs: int):
        self.keys, at = np.unique(items, return_inverse=True)
        count = np.bincount(at * n_langs + lang, n, len(self.keys) * n_langs).reshape(-1, n_langs)
        total = np.maximum(count.sum(axis=0), 1)
        lack = -np.log(total) - PENALTY
        self.rows = np.where(count > 0, np.log(np.maximum(count, 1) / total), lack).astype(np.float32)

    def find(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which items are known, the rows of those)."""
        if not len(self.keys):
            return np.zeros(len(items), bool), self.rows
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        known = self.keys[at] == items
        return known, self.rows[at[known]]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words, each between two spaces; number of the word at each)."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])


def gram_hashes(codes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the word) of all n-grams of this length."""
    n = max(len(codes) - length + 1, 0)
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_constants(LONGEST, 41)[:length]):
        total += (codes[j : j + n] + np.uint64(1)) * c
    whole = owner[:n] == owner[length - 1 :][:n]
    return mix(total[whole]), owner[:n][whole]


class Backoff:
    """Scores of words and of n-grams by length, from counts (lang, word, n)."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        lang = np.searchsorted(np.array(self.langs, object), counts["lang"].to_numpy(object)) if self.langs else np.empty(0, np.int64)
        words, n = counts["word"].tolist(), counts["n"].to_numpy(float)
        self.words = Scores(word_hashes(words), lang, n, len(self.langs) or 1)
        codes, owner = characters(words)
        self.grams = []
        for length in range(1, LONGEST + 1):
            h, own = gram_hashes(codes, owner, length)
            self.grams.append(Scores(h, lang[own], n[own], len(self.langs) or 1))

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        out = np.zeros((len(words), len(self.langs)))
        known, rows = self.words.find(word_hashes(words))
        out[known] = rows
        rest = np.flatnonzero(~known)
        codes, owner = characters([words[i] for i in rest])
        open_ = np.ones(len(rest), bool)
        for length in range(LONGEST, 0, -1):
            h, own = gram_hashes(codes, owner, length)
            h, own = h[open_[own]], own[open_[own]]
            hit, rows = self.grams[length - 1].find(h)
            own = own[hit]
            count = np.bincount(own, minlength=len(rest))
            done = np.flatnonzero(count)
            for k in range(len(self.langs)):
                out[rest[done], k] = (np.bincount(own, rows[:, k], len(rest)))[done] / count[done]
            open_[done] = False
        return out


class _Known(dict):
    """Places of words in a growing table of score rows."""

    def __init__(self, model: Backoff):
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self]
        if fresh:
            self.update(zip(fresh, range(len(self), len(self) + len(fresh))))
            self.rows = np.concatenate([self.rows, self.model.score(fresh)])

    def forget(self) -> None:
        self.clear()
        self.rows = self.rows[:0]


def learn(docs: DataFrame, keep, per_lang: int = PER_LANG) -> Backoff:
    """Scores from the rows of docs where keep holds and lang is known."""

    def make():
        def run(rows):
            count = Counter((lang, w) for lang, text in zip(rows["lang"], rows["text"]) for w in words_in(text))
            return {"lang": [k[0] for k in count], "word": [k[1] for k in count], "n": list(count.values())}

        return run

    known = docs.select("doc_id", "text", "lang").where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    words = map_rows(bounded_sample(known, "doc_id", "lang", per_lang).select("lang", "text"), make, "lang string, word string, n long")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    return Backoff(counts.sort_values(["lang", "word"]))


def predicted(docs: DataFrame, model: Backoff) -> DataFrame:
    """doc_id, lang_pred and score (the share of the best language's probability) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known, langs = _Known(shared.value), shared.value.langs

        def run(rows):
            if len(known) > KEEP:
                known.forget()
            split = [words_in(t) for t in rows["text"]]
            if langs:
                known.learn([w for ws in split for w in ws])
            lang, score = [], []
            for words in split:
                if not langs or not any(c.isalpha() for w in words for c in w):
                    lang.append("und")
                    score.append(0.0)
                    continue
                mean = known.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].mean(axis=0)
                best = int(np.argmax(mean))
                lang.append(langs[best])
                score.append(float(1 / np.exp((mean - mean[best]) * SHARPNESS).sum()))
            return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score}

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op4(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, learn(docs, F.coalesce(fold("doc_id", 4), F.lit(2)) != 2))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
