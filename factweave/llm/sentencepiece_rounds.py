"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The symbols of all words that are still open lie in flat numpy arrays, each linked to its neighbours. A round takes the
segmented minimum of the pair ranks of each word and merges all places of that rank at once, from the left and without
overlaps; then only the pairs beside new symbols get new ranks. Where a merge makes a pair of the same or a better rank, the
one-at-a-time order would take that pair first, so the word's merges of this round end there. Ids are thus those of the
library. The arrays are compacted as symbols go, until no pair remains. A word is what starts at a run of word marks: no
piece of the vocabulary continues past a mark, so merges never cross words. Words of any length go the same way.

Null and empty texts have no tokens but begin and end. Each row is encoded by itself, whatever its doc_id; further columns
play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

MARK = "▁"
KEEP = 150_000
NO_RANK = np.int64(1 << 30)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message; values are ints or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            n, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """Vocabulary and merge table of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append(piece[1].decode())
                    scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                    self.kinds.append(piece.get(3, 1))
        self.unk, self.bos, self.eos = self.kinds.index(2), self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.raw = [byte_of.get(i, b"" if self.kinds[i] in (2, 3) else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    self.merges[a, b] = (order[scores[i]], i)
        self.width = len(self.pieces) + 1
        keys = np.array([a * self.width + b for a, b in self.merges], np.int64)
        turn = np.argsort(keys)
        self.keys = keys[turn]
        both = np.array(list(self.merges.values()), np.int64)[turn]
        self.ranks, self.made = both[:, 0], both[:, 1]
        self.none = len(self.pieces)  # a symbol that is in no piece
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces go past word marks; words can't be encoded by themselves")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; NO_RANK for pairs that don't merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.made[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word by merge rounds."""
        get, none = self.ids.get, self.none
        sym = np.array([get(c, none) for w in words for c in w], np.int64)
        seg = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
        if len(sym):
            inner = np.flatnonzero(seg[:-1] == seg[1:])
            rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        done_sym, done_seg = [], []
        while len(sym):
            # Compacted: symbols of open words only, side by side; n stands for no neighbour.
            n = len(sym)
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(starts, n))
            low = np.minimum.reduceat(rank, starts)
            alive = np.repeat(low < NO_RANK, size)
            done_sym.append(sym[~alive])
            done_seg.append(seg[~alive])
            sym, seg, rank, made = sym[alive], seg[alive], rank[alive], made[alive]
            n = len(sym)
            if not n:
                break
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(starts, n))
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            after[starts[1:] - 1], before[starts] = n, n
            after, before, sym = np.append(after, n), np.append(before, n), np.append(sym, none)
            live = np.ones(n, bool)
            left = n
            while left > n // 2:
                low = np.minimum.reduceat(rank, starts)
                if not (low < NO_RANK).any():
                    break
                at = np.flatnonzero(rank == np.repeat(np.where(low < NO_RANK, low, -1), size))
                at = self._commuting(at, sym, seg, rank, made, after, before)
                gone = after[at]
                sym[at] = made[at]
                live[gone], rank[gone] = False, NO_RANK
                after[at] = after[gone]
                follow = after[at] < n
                before[after[at[follow]]] = at[follow]
                rank[at[~follow]] = NO_RANK
                fresh = np.unique(np.append(at[follow], before[at][before[at] < n]))
                rank[fresh], made[fresh] = self._pairs(sym[fresh], sym[after[fresh]])
                left -= len(at)
            sym, seg, rank, made = sym[:n][live], seg[live], rank[live], made[live]
        sym, seg = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_sym, done_seg))
        turn = np.argsort(seg, kind="stable")
        sym, seg = sym[turn], seg[turn]
        ends = np.cumsum(np.bincount(seg, minlength=len(words)))
        odd = set(seg[sym == none].tolist())
        flat = sym.tolist()
        out, begin = [], 0
        for k, end in enumerate(ends.tolist()[: len(words)]):
            out.append(self._spell(words[k], flat[begin:end]) if k in odd else flat[begin:end])
            begin = end
        return out

    def _commuting(self, at: np.ndarray, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, made: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The places of least rank that merge in this round: from the left without overlaps, up to the first whose merge makes a pair that comes no later."""
        if len(at) > 1 and (overlap := after[at[:-1]] == at[1:]).any():
            run = np.flatnonzero(np.append(True, ~overlap))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]
        word = seg[at]
        head = np.append(True, word[1:] != word[:-1])
        if head.all():
            return at
        first = np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(at))))
        beside = before[at]
        lefts = sym[beside]
        merged = np.append(False, after[at[:-1]] == beside[1:]) & (beside < len(seg))
        lefts[merged] = made[at[np.flatnonzero(merged) - 1]]
        rights = sym[after[after[at]]]
        better = (self._pairs(lefts, made[at])[0] <= rank[at]) | (self._pairs(made[at], rights)[0] <= rank[at])
        stopped = np.cumsum(better) - better
        return at[stopped == stopped[first]]

    def _spell(self, word: str, symbols: list[int]) -> list[int]:
        """Characters that are in no piece become their bytes."""
        out, at = [], 0
        for s in symbols:
            if s == self.none:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(s)
                at += len(self.pieces[s])
        return out

    def words(self, text: str) -> list[str]:
        return re.findall(f"{MARK}+[^{MARK}]*", (MARK + text).replace(" ", MARK)) if text else []

    def encode(self, text: str | None, bos: bool = True, eos: bool = True) -> list[int]:
        body = [i for x in self.encode_words(self.words(text or "")) for i in x]
        return [self.bos] * bos + body + [self.eos] * eos

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark that encoding puts first goes, bytes that are no UTF-8 become U+FFFD."""
        parts = b"".join(self.raw[i] for i in ids)
        return (parts[1:] if parts[:1] == b" " else parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, token_ids and decoded of every whole text."""
    extra = ", token_ids array<int>, decoded string" if keep_ids else ""

    def make():
        model = load(path or default_model())
        known: dict[str, tuple[bytes, bytes]] = {}
        first, last = struct.pack("<I", model.bos), struct.pack("<I", model.eos)

        def run(rows):
            if len(known) > KEEP:
                known.clear()
            split = [model.words(t or "") for t in rows["text"]]
            fresh = list({w for ws in split for w in ws if w not in known})
            for w, ids in zip(fresh, model.encode_words(fresh)):
                known[w] = (np.array(ids, "<u4").tobytes(), b"".join([model.raw[i] for i in ids]))
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "token_ids": [], "decoded": []}
            for ws in split:
                got = [known[w] for w in ws]
                ids = b"".join([first, *[x[0] for x in got], last])
                text = b"".join([x[1] for x in got])[1:]
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    out["token_ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    out["decoded"].append(text.decode("utf-8", "replace"))
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def op7(spark, sf_dir) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
