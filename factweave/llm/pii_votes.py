"""Personal data by weak supervision.

Regexes propose spans. Labelers of three sorts vote on each span (1: personal data, -1: not, 0: no opinion):
format checks, gazetteers, and words before the span. Votes are counted by pattern over the whole corpus; there are at
most 3 ** (number of labelers) patterns per kind, whatever the corpus holds. Expectation-maximisation over the counts
estimates how reliable each labeler is, and the share of real spans of each kind. The posteriors then train a logistic
classifier on coarse features of the spans, again on counts of feature patterns. It decides on the proposed spans that
are not base spans; base spans always stay.

Base spans are what the four fixed rules give. They work left to right without overlaps within a kind; a match that
fails its test is dropped and not tried again.

Null and empty texts have no spans. Spans are in code points, the end exclusive. A proposal that overlaps a base span is
left out; base spans of different kinds may overlap, and redaction joins those that do. Each row is read by itself, whatever
its doc_id; repeated rows count as often as they are there. Time is linear in a text but for the sorting of its spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "local_phone", "national_id", "iban")
KINDS = BASE + EXTRA
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts: nothing that fails there succeeds within the run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What a secret can hold beside digits: stripped of it, a span goes from its first digit to its last.
NO_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
LETTER = re.compile(r"[A-Za-z]")
PROPOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{20,}+"),
    "local_phone": re.compile(r"(?<![0-9+.\-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9.\-])"),
    "national_id": re.compile(r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
# Gazetteers and context words.
DOMAIN_ENDS = frozenset("com org net edu gov io de fr es uk eu info co".split())
KEY_PREFIXES = ("sk-", "pk_", "AKIA", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ")
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
DIAL_CODES = ("+1", "+20", "+27", "+30", "+31", "+32", "+33", "+34", "+39", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+55", "+61", "+81", "+86", "+91")
CONTEXT = {
    "email": re.compile(r"(?i)(?:mail|contact|write|reach)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "ip": re.compile(r"(?i)(?:\bip\b|host|server|address|login)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "card": re.compile(r"(?i)(?:card|visa|credit|payment)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "phone": re.compile(r"(?i)(?:tel|phone|call|fax|mobile)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "secret": re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|\bkey|bearer)\W{0,6}\Z"),
    "local_phone": re.compile(r"(?i)(?:tel|phone|call|fax|mobile)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "national_id": re.compile(r"(?i)(?:ssn|social|security|identity)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
    "iban": re.compile(r"(?i)(?:iban|account|bank)\W{0,4}(?:\w+\W{1,3}){0,2}\Z"),
}
LABELERS = ("format", "gazetteer", "context", "shape")
FEATURES = 5
START = 0.7


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """In time linear in the text: from each @ to the left, then to the right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = AT_DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def proposed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of proposals that overlap no base span."""
    got = [(kind, *m.span()) for kind, p in PROPOSE.items() for m in p.finditer(text)]
    if not got or not base:
        return got
    starts, ends = zip(*sorted(s[1:] for s in base))
    reach = [0, *accumulate(ends, max)]
    # Of the base spans that start before a proposal ends, the one that reaches farthest decides.
    return [s for s in got if reach[bisect_left(starts, s[2])] <= s[1]]


def _entropy(s: str) -> float:
    n = np.array(list(Counter(s).values()), float) / len(s)
    return float(-(n * np.log2(n)).sum())


def _format(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "secret":
        return 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", s) else -1 if not d or s.isdigit() or "-" in s.strip("-") and not LETTER.search(s.strip(NO_DIGITS)) else 0
    if kind == "iban":
        turned = s.replace(" ", "")
        turned = turned[4:] + turned[:4]
        return 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    if kind == "national_id":
        return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    if kind == "local_phone":
        return 1 if d[0] > "1" and d[3] > "1" else -1
    return 1


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in DOMAIN_ENDS else 0
    if kind == "secret":
        return 1 if s.startswith(KEY_PREFIXES) else 0
    if kind == "iban":
        return 1 if s[:2] in COUNTRIES else -1
    if kind == "phone":
        return 1 if s.startswith(DIAL_CODES) else 0
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.")) else 0
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    return 0


def _shape(kind: str, s: str) -> int:
    """How many different characters there are for the length: numbers and keys that people type as examples repeat."""
    plain = re.sub(r"\W", "", s)
    if kind == "secret":
        return 1 if _entropy(s) > 3.4 and any(c.isdigit() for c in s) else -1 if _entropy(s) < 2.8 else 0
    return -1 if len(set(plain)) <= 2 else 0


def votes(kind: str, text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    return [_format(kind, s), _gazetteer(kind, s), 1 if CONTEXT[kind].search(text[max(0, a - 40) : a]) else 0, _shape(kind, s)]


def features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Coarse values from 0 to 3; the number of patterns has a bound."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s) / len(s)
    return [min(3, len(s) // 12), min(3, int(4 * digits)), min(3, int(_entropy(s))), int(bool(CONTEXT[kind].search(text[max(0, a - 40) : a]))), int(text[a - 1 : a] in ('"', "'", "=", ":")) if a else 0]


SPANS = "array<struct<kind: int, start: int, end: int, base: boolean, votes: int, feats: int>>"


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, row digest columns of the base rules, and all spans with votes and features packed into integers."""

    def make():
        def run(rows):
            out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")} | {"doc_id": rows["doc_id"]}
            for text in rows["text"]:
                text = text or ""
                base = base_spans(text)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(digest(base))
                found = []
                for own, spans in ((True, base), (False, proposed_spans(text, base))):
                    for kind, a, b in spans:
                        v = sum((x + 1) * 3**k for k, x in enumerate(votes(kind, text, a, b)))
                        f = sum(x * 4**k for k, x in enumerate(features(kind, text, a, b)))
                        found.append({"kind": KINDS.index(kind), "start": a, "end": b, "base": own, "votes": v, "feats": f})
                out["spans"].append(found)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans " + SPANS)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, reliability of each labeler, share of each kind) from counted vote patterns.

    The model is the usual one: a labeler that has an opinion is right with its own probability, independent of others.
    """
    right = np.full(len(LABELERS), START)
    share = np.full(len(KINDS), 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kind] / (1 - share[kind])) + vote @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j in range(len(LABELERS)):
            agree = (n * np.where(vote[:, j] > 0, post, np.where(vote[:, j] < 0, 1 - post, 0))).sum()
            right[j] = np.clip((agree + 2 * START) / ((n * (vote[:, j] != 0)).sum() + 2), 0.55, 0.98)
        for k in range(len(KINDS)):
            mine = kind == k
            share[k] = np.clip(((n * post)[mine].sum() + 1) / (n[mine].sum() + 2), 0.05, 0.95)
    return post, right, share


def _design(kind: np.ndarray, feats: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(KINDS))[kind]]
    for k in range(FEATURES):
        parts.append(np.eye(4)[feats // 4**k % 4])
    return np.concatenate(parts, axis=1)


def train(spans: DataFrame) -> np.ndarray:
    """Weights of the span classifier. Only counts by (kind, votes, features) come to the driver; their number has a bound."""
    got = spans.groupBy("kind", "votes", "feats").count().toPandas().sort_values(["kind", "votes", "feats"])
    return classifier(*(got[c].to_numpy() for c in ("kind", "votes", "feats", "count")))


def classifier(kind: np.ndarray, packed: np.ndarray, feats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression on the posteriors of counted (kind, votes, features)."""
    w = np.zeros(len(KINDS) + 4 * FEATURES)
    if not len(n):
        return w
    n = n.astype(float)
    vote = np.stack([packed // 3**k % 3 - 1 for k in range(len(LABELERS))], axis=1)
    post, _, _ = reliabilities(kind, vote, n)
    x, n = _design(kind, feats), n / n.sum()
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - post)) + 1e-4 * w
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), grad)
    return w


def detect(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id, digests, and accepted: array of (kind, start, end) of base spans and of spans that the classifier accepts."""
    told = written(proposals(docs), "spans")
    w = train(told.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.feats"))
    level = float(np.log(keep / (1 - keep)))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    weights = [float(x) for x in w]

    def score(s):
        total = F.element_at(F.array(*[F.lit(x) for x in weights[: len(KINDS)]]), s["kind"] + 1)
        for k in range(FEATURES):
            at = F.shiftright(s["feats"], 2 * k).bitwiseAND(F.lit(3))
            total = total + F.element_at(F.array(*[F.lit(x) for x in weights[len(KINDS) + 4 * k : len(KINDS) + 4 * k + 4]]), at + 1)
        return total

    accepted = F.filter("spans", lambda s: s["base"] | (score(s) >= level))
    named = F.transform(accepted, lambda s: F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return told.withColumn("accepted", named).drop("spans")


def accepted_spans(text: str, weights: np.ndarray, keep: float = 0.5) -> list[tuple[str, int, int]]:
    """Base spans and the proposals that the classifier accepts."""
    base = base_spans(text)
    more = proposed_spans(text, base)
    if more:
        packed = np.array([sum(x * 4**k for k, x in enumerate(features(*s[:1], text, *s[1:]))) for s in more])
        score = _design(np.array([KINDS.index(k) for k, _, _ in more]), packed) @ weights
        more = [s for s, x in zip(more, score) if x >= np.log(keep / (1 - keep))]
    return base + more


def redact(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The documents with each accepted span replaced by its kind in brackets; all columns stay, n_chars is counted anew.

    The classifier is trained on all rows first; then each row finds its own spans again, so that no text is shuffled.
    """
    weights = train(proposals(docs).select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.feats"))
    names = docs.columns

    def clean(text: str | None) -> str | None:
        spans = accepted_spans(text, weights, keep) if text else []
        if not spans:
            return text
        parts, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def make():
        return lambda rows: {**rows, "text": [clean(t) for t in rows["text"]]}

    first = ["doc_id", "text"]
    rest = [c for c in names if c not in first]
    types = dict(docs.dtypes)
    out = map_rows(docs.select(*first, *rest), make, ", ".join(f"`{c}` {types[c]}" for c in [*first, *rest])).select(*names)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out


def op2(spark, sf_dir) -> DataFrame:
    got = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)])
    ordered = F.array_sort(F.transform("accepted", lambda s: F.struct(F.element_at(rank, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"))
