"""Archives, vector codes and ranked search: against SQL, plain versions and exact round trips, with odd rows."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import lexical_search, vector_codes, warc_archives
from factweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_warc", "op12_vector_codes", "op13_lexical_search"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(int(r[i]) if isinstance(r[i], Decimal) else r[i] for i in at) for r in want.fetchall()), key=repr)


# Archives

PAGES = [
    (5, "http://a.com/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://b.com/\r\nWARC-Type: warcinfo", "é" * 70_000), (1, "http://c.com", None), (3, "http://c.com", ""), (2, None, "<p>one</p>"),
    (None, "http://d.com", "<p>one</p>"), (None, "http://d.com", "only here"), (None, "http://e.com", "only here"), (7, "http://f.com/ü", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (-4, "", "é" * 70_000),
]


def pages_expected(rows, least=0):
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= least else None
        again = to is not None and to != k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([r + ("x", 3, "y") for r in PAGES], "page_id long, url string, html string, digest string, first int, archive string").repartition(3)


@pytest.mark.parametrize("least, few", [(0, 500_000), (0, 0), (11, 500_000)])
def test_op11_odd_pages(spark, pages, monkeypatch, least, few):
    monkeypatch.setattr(warc_archives, "FEW_COPIES", few)
    got = warc_archives.read_records(warc_archives.archived(spark, pages, least, most=1000))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == pages_expected(PAGES, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_op11_no_pages(spark, pages):
    assert warc_archives.read_records(warc_archives.archived(spark, pages.limit(0))).count() == 0


def test_op11_members_and_index(spark, pages, tmp_path):
    rows = warc_archives.write_archives(warc_archives.with_first(pages), str(tmp_path / "a"), most=100_000).collect()
    made = spark.createDataFrame([tuple(r) for r in rows], "archive string, records long")
    whole = {r.archive: gzip.decompress(open(r.archive, "rb").read()) for r in made.collect()}
    out = warc_archives.normalised(made, str(tmp_path / "b")).collect()
    assert all(r.whole for r in out) and sum(r.records for r in out) == len(PAGES) + len(whole)
    texts = []
    for r in out:
        data, at, text = open(r.archive, "rb").read(), 0, b""
        for line in open(r["index"]):
            x = json.loads(line)
            assert x["offset"] == at
            member = zlib.decompressobj(31)
            piece = member.decompress(data[at : at + x["length"]])
            assert member.eof and not member.unused_data and piece.startswith(b"WARC/1.1\r\nWARC-Type: " + x["type"].encode())
            at, text = at + x["length"], text + piece
        assert at == len(data)
        texts.append(text)
    assert sorted(texts) == sorted(whole.values())
    assert not any(re.search(rb"WARC-Target-URI: [^\r]*\r\n[^WC]", t) for t in texts)


@pytest.mark.parametrize("kind", ["several members", "plain", "cut", "damaged", "no archive", "empty"])
def test_op11_streams_of_others(spark, tmp_path, kind):
    records = [b"".join(warc_archives.page_record(k, "http://a.com", "text " * k, hashlib.sha1(b"text " * k).digest(), None)) for k in range(1, 400)]
    data = b"".join(records)
    packed = {
        "several members": gzip.compress(data[:5000]) + gzip.compress(data[5000:]), "plain": data, "cut": gzip.compress(data)[:-4000], "damaged": gzip.compress(data[:9000]) + b"\x1f\x8b\x08" + b"\xff" * 900,
        "no archive": gzip.compress(b"some text\r\n\r\nmore"), "empty": b"",
    }[kind]
    (tmp_path / "x.warc.gz").write_bytes(packed)
    row = warc_archives.normalised(spark.createDataFrame([(str(tmp_path / "x.warc.gz"),)], "archive string"), str(tmp_path / "out")).first()
    assert row.whole == (kind in ("several members", "plain", "empty"))
    got = gzip.decompress(open(row.archive, "rb").read())
    assert got == b"".join(records[: row.records])
    if kind in ("several members", "plain"):
        assert row.records == len(records)
    if kind in ("cut", "damaged"):
        assert 0 < row.records < len(records)


def test_op11_memory_of_a_stream():
    """A stream is inflated in pieces of bounded size."""
    packed = gzip.compress(b"a" * 50_000_000)
    assert max(map(len, warc_archives.inflated(io.BytesIO(packed)))) <= warc_archives.CHUNK
    assert sum(map(len, warc_archives.inflated(io.BytesIO(packed)))) == 50_000_000


def test_op11_wrong_digest():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabd"
    with pytest.raises(ValueError):
        warc_archives.described({"warc-type": "response", "warc-record-id": "<urn:x-page:1>", "warc-payload-digest": "sha1:" + warc_archives.base32(hashlib.sha1(b"abc").digest())}, block)


# Vector codes


def test_op12_partial_distances():
    r = np.random.default_rng(5)
    for spread in (2, 5, 1 << 20, vector_codes.LARGEST):
        for k in (1, 3, 16):
            x, book = r.integers(-spread, spread, (400, 8)), r.integers(-spread, spread, (k, 8))
            book[-1] = book[0]
            code, error = vector_codes.Codebooks(book[None]).nearest(x)
            all_ = ((x[:, None] - book) ** 2).sum(axis=2)
            assert (code[:, 0] == all_.argmin(axis=1)).all() and (error[:, 0] == all_.min(axis=1)).all()


def test_op12_order_of_dimensions():
    book = np.array([[[0, 5, 1], [0, -5, 2], [0, 1, 9]]])
    assert vector_codes.Codebooks(book).order.tolist() == [[1, 2, 0]]


def codes_expected(rows, parts, entries, rounds):
    """In plain Python integers."""
    rows = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v and len(v) % parts == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    d = len(rows[0][1]) // parts
    whole = [[max(-vector_codes.LARGEST, min(vector_codes.LARGEST, math.floor(4096 * x))) for x in v] for _, v, _ in rows]
    cut = [[v[p * d : p * d + d] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min((dist(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        own = [assign(v) for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                if mine := [v[p] for v, a in zip(cut, own) if a[p][1] == k]:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    own, total = [assign(v) for v in cut], defaultdict(int)
    for (_, _, label), a in zip(rows, own):
        total[label] += sum(x for x, _ in a)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{c:02x}" for _, c in a), sum(x for x, _ in a), total[label], sha) for (k, _, label), a in zip(rows, own)), key=repr)


@pytest.mark.parametrize("few, n", [(100_000, 300), (0, 300), (100_000, 9), (100_000, 1)])
def test_op12_odd_vectors(spark, monkeypatch, few, n):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    r = random.Random(n)
    rows = [(k, [r.choice([-1.5, -0.1, 0.0, 0.3, 0.25, r.random()]) for _ in range(16)], r.choice([None, 1, 2, 3])) for k in range(n)]
    odd = [(2, None, 1), (4, [0.5] * 15 + [None], 1), (5, [0.5] * 15 + [float("nan")], 1), (6, [0.5] * 15 + [float("inf")], 1), (-7, [], 1), (-6, [1.0] * 15, 2), (8, [1.0] * 8, 2), (None, [0.2] * 16, None), (3, [9.0] * 16, 1), (3, [9.0] * 16, 1), (9, [4e4] * 16, 7), (10, [-3e38] * 16, 7)]
    rows = [x for x in rows + odd if x[1] is None or len(x[1]) != 8 or n > 1]
    df = spark.createDataFrame([x + ("s", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = vector_codes.with_label_error(vector_codes.encoded(vector_codes.kept(df), books := vector_codes.fit(vector_codes.kept(df)))).withColumn("sha", F.lit(books.digest()))
    f32 = [(k, v and [x if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    assert sorted((tuple(x) for x in got.select("vec_id", "code", "error", "label_error", "sha").collect()), key=repr) == codes_expected(f32, 8, 16, 6)


def test_op12_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2), (2, [], None)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.with_label_error(vector_codes.encoded(vector_codes.kept(df), vector_codes.fit(vector_codes.kept(df)))).count() == 0


# Ranked search


def cost_of(scores, cuts, price):
    return sum(max(scores[a:b]) * (b - a) for a, b in zip([0, *cuts], cuts)) + price * max(scores) * len(cuts)


def test_op13_blocks_of_least_cost():
    r = random.Random(3)
    lists = [[r.randint(1, 9) for _ in range(n)] for n in (1, 0, 7, 10, 2, 9)]
    flat, ends = np.array([x for xs in lists for x in xs]), np.cumsum([len(x) for x in lists])
    for price, longest in ((0.5, 4), (2, 128), (0, 3), (0.1, 5)):
        got = lexical_search.block_ends(flat, ends, longest, price).tolist()
        for xs, end in zip(lists, ends.tolist()):
            cuts = [g - end + len(xs) for g in got if end - len(xs) < g <= end]
            if not xs:
                continue
            every = [[k + 1 for k, c in enumerate(cut) if c] + [len(xs)] for cut in product((0, 1), repeat=len(xs) - 1)]
            best = min(cost_of(xs, c, price) for c in every if all(b - a <= longest for a, b in zip([0, *c], c)))
            assert cuts[-1] == len(xs) and math.isclose(cost_of(xs, cuts, price), best)


def shard_of(r, n_docs, terms):
    shard = lexical_search._Shard()
    for k in range(n_docs):
        found = {w: r.choice([1, 1, 2, 9]) for w in terms if r.random() < 0.4}
        shard.add(k, sum(found.values()) + r.randint(0, 30) + 1, found)
    return lexical_search.arrays(shard.row(), 0), sum(shard.lengths)


def test_op13_search_of_a_shard_skips_and_is_exact():
    r = random.Random(8)
    terms = [b"a", b"b", b"c", b"d", b"e", b"f"]
    row, total = shard_of(r, 4000, terms)
    weights = {"a": 9000, "b": 200, "c": 900, "d": 0, "e": 20, "f": 4000}
    one = lexical_search.Searcher(row, weights, 4000, total)
    plain = defaultdict(Counter)
    for k, t in enumerate(row["terms"]):
        for p in range(row["ends"][k - 1] if k else 0, row["ends"][k]):
            tf, place = int(row["counts"][p]), int(row["places"][p])
            m = 50 + (50 * int(row["lengths"][place]) * 4000) // total
            plain[t][place] = weights[t] * (10**9 * tf // (1000 * tf + 20 * m))
    assert all((one.largest[np.searchsorted(one.block_end, p, side="right")] >= s) for p, s in enumerate(one.scores))
    read = []
    scored = one.scored
    one.scored = lambda blocks, *rest: (read.append((len(rest[-1]), len(rest[2]) - 1)), scored(blocks, *rest))[1]
    for asked in (["a"], ["a", "b", "c", "e"], ["d"], ["f", "a", "x"], ["x"], ["b", "e"]):
        for top in (1, 10, 50, 5000):
            whole = Counter()
            for t in asked:
                whole.update(plain[t])
            want = sorted(((-s, p) for p, s in whole.items() if s > 0))[:top]
            places, scores = one.best(asked, top)
            assert [(-int(s), int(p)) for s, p in zip(scores, places)] == want
            if len(want) == top:
                assert one.best(asked, top, -want[-1][0])[0].tolist() == [p for _, p in want]
                assert not len(one.best(asked, top, -want[0][0] + 1)[0])
    read.clear()
    one.best(["a", "f"], 10)
    assert sum(x for x, _ in read) < 0.5 * read[0][1]


def search_expected(docs, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(k, Counter(words(t))) for k, t in docs]
    bags = [(k, b) for k, b in bags if b]
    n, total, df = len(bags), sum(b.total() for _, b in bags), Counter(w for _, b in bags for w in b)
    asked = defaultdict(set)
    for k, t in items:
        asked[k] |= set(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for k, b in bags:
            m = 50 + 50 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in terms if w in b)
            if s > 0:
                found.append((-s, k is None, k or 0))
        out += [(item, rank, None if none else k, -s) for rank, (s, none, k) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_terms, postings", [(200_000, 2_000_000), (12, 60)])
def test_op13_odd_rows(spark, monkeypatch, most_terms, postings):
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    monkeypatch.setattr(lexical_search, "PRIMING", 2)
    monkeypatch.setattr(lexical_search.shards, "__defaults__", (postings,))
    r = random.Random(1)
    words = ["Alpha", "beta", "gam-ma", "Éa", "éa", "x1", "日本", "_", "the", "the", "the", "ÀB", "z\x7fz", "\x00"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for k in range(200)]
    docs += [(7, "Alpha beta"), (7, "Alpha beta"), (None, "alpha BETA"), (None, None), (300, ""), (301, "-- !!"), (302, "y" * 100_000), (303, "alpha " * 5000)] + [(k, "alpha beta") for k in range(400, 480)]
    items = [(1, "ALPHA beta!"), (2, None), (3, "nothing here"), (4, "the 日本 Éa"), (4, "x1"), (None, "gam z"), (5, "alpha beta"), (6, "--")]
    df = spark.createDataFrame([x + ("q", 1.0, 2) for x in docs], "doc_id long, text string, shard string, score double, rank int").repartition(4)
    asked = spark.createDataFrame([x + (1,) for x in items], "item_id long, text string, score int")
    got = lexical_search.search(df, asked, 50, most_terms)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == search_expected(docs, items, 50)


def test_op13_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(x) for x in lexical_search.search(docs, items).collect()] == search_expected([(1, "a b")], [(1, "a")], 50)
