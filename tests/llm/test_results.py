"""Results against brute force, the sentencepiece library, exact round trips and held-out labels."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import decontaminate, license_scan, near_duplicates, pii_votes, quality_trees, repeats, sentencepiece_rounds, url_rules
from factweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[next(n for n in QUERIES if n.startswith(name + "_"))](spark, DATA).collect()


def test_op7_equals_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_rounds.default_model())
    got = {r["doc_id"]: r for r in run(spark, "op7")}
    for k, t in texts.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == want


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "a▁b ▁▁ c", "<s>", "漢字 😀\x00", "abab" * 500, "a" * 700, "x" + " " * 70 + "y"])
def test_op7_odd_texts(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_rounds.default_model())
    model = sentencepiece_rounds.load(sentencepiece_rounds.default_model())
    ids = model.encode(text)
    assert ids == lib.encode(text, add_bos=True, add_eos=True) and model.decode(ids) == lib.decode(ids)


def removed(rows, length=100):
    """Brute force over all strings."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("few", [1, 400])
def test_op9(spark, texts, monkeypatch, few):
    monkeypatch.setattr(repeats, "FEW", few)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op9")}
    assert got == removed(texts.items())


def test_op9_parts_of_long_texts(monkeypatch):
    texts = ["ab" * 700, "".join(chr(97 + i * i % 23) for i in range(900)), "é" * 300, "x" * 99]
    whole = [list(repeats.scans([t], 100, 40)) for t in texts]
    monkeypatch.setattr(repeats, "CHUNK", 64)
    for t, one in zip(texts, whole):
        starts = sorted(s for x in repeats.scans([t], 100, 40) for a, b in zip(x["first"], x["last"]) for s in range(a, b + 1))
        assert starts == list(range(max(0, len(t.encode()) - 99)))
        keys = lambda xs: {(int(k), int(at)) for x in xs for k, at in zip(x["k"], x["at"])}
        assert keys(repeats.scans([t], 100, 40)) == keys(one)


def classes(texts, width, percent):
    sets, inv = {}, defaultdict(list)
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in sorted(texts):
        w = texts[k].encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        both = defaultdict(int)
        for s in sets[k]:
            for j in inv[s]:
                both[j] += 1
            inv[s].append(k)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def test_op10(spark, texts):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op10")} == classes(texts, 4, 80)


def test_op10_chains_without_a_hub(spark):
    """Neighbours are near, far ends are not; no document is near to all."""
    words = [f"w{i}" for i in range(400)]
    texts = {100 + k: " ".join(words[12 * k : 12 * k + 160]) for k in range(8)} | {k: " ".join(words[5 * k : 5 * k + 200] + [f"t{k}"]) for k in (1, 9, 17)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs, 4, 80).collect()}
    assert got == classes(texts, 4, 80)


def test_verification_never_prunes_what_reaches_the_threshold():
    least = near_duplicates.least_matches(0.8)
    assert all(m <= 0.8 * 16 * (k + 1) for k, m in enumerate(least)) and least == sorted(least)


def test_op2_base(spark, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)
    for r in run(spark, "op2"):
        t = texts[r["doc_id"]]
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii_votes.luhn(digits(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert r["base_sha256"] == pii_votes.digest(base)
        assert all(f"{k}:{a}:{b}" in r["spans"].split(",") for k, a, b in base)


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4", "1.2.3", "+1 (23) 456-7890+1234567890", "4111 1111-1111 1111 4111111111111112", "+1((((1+" * 50])
def test_op2_odd_texts(text):
    plain = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    plain += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    got = pii_votes.base_spans(text)
    assert [s for s in got if s[0] in ("email", "ip")] == plain


def test_op2_votes():
    kind, vote, n = np.zeros(4, int), np.array([[1, 1, 1, 1], [-1, 0, 0, -1], [1, 0, 1, 0], [-1, -1, 0, 0]]), np.array([50.0, 60, 20, 30])
    post, right, _ = pii_votes.reliabilities(kind, vote, n)
    assert post[0] > 0.9 > 0.1 > post[1] and post[2] > 0.5 > post[3] and (right > 0.5).all()


def test_op6_base(spark, texts):
    for r in run(spark, "op6"):
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        again = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_trees_keep_their_constraints():
    r = np.random.default_rng(1)
    x = r.random((800, 2))
    y = ((x[:, 0] < 0.6) ^ (r.random(800) < 0.2)).astype(float)
    f = quality_trees.boost(x, y, np.ones(800), [-1, 0], trees=20)
    grid = np.linspace(0, 1, 101)
    for b in (0.1, 0.5, 0.9):
        assert (np.diff(f.score(np.stack([grid, np.full(101, b)], axis=1))) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.95


def test_op3(spark, texts):
    want = set()
    for k, t in texts.items():
        have = set(license_scan.plain_shingles(t))
        for name, template in license_scan.TEMPLATES.items():
            s = license_scan.plain_shingles(template)
            if sum(x in have for x in s) >= license_scan.LEAST * len(s):
                want.add((k, name))
    got = run(spark, "op3")
    assert {(r["doc_id"], r["license"]) for r in got} == want and want
    assert license_scan.miss_probability(0.25) < 2e-6


def test_op3_changed_text(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    docs = spark.createDataFrame([(1, "x " * 333 + mit.replace("merge", "merges") + " y" * 99), (2, " ".join(w for i, w in enumerate(mit.split()) if i % 4)), (3, mit.upper())], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()} == {(1, "MIT-text"), (3, "MIT-text")}


def test_op8(spark):
    item = "A train leaves Paris at 9 and travels 120 km in 2 hours then Anna drives back 120 km in 3 hours how fast was each of the two trips"
    docs = spark.createDataFrame(
        [
            (1, "intro words here. " + item + " and more words after it"),
            (2, item.replace("120", "75").replace("Anna", "Sarah").lower()),
            (3, item.replace("120", "75", 1)),
            (4, "a train leaves the station at noon and nobody knows how fast it was on the way back home"),
            (5, None),
            (6, item.replace("120", "75", 1).replace("3 hours", "5 hours")),
        ],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    # One value meets two fillings in 3 and 6; 3 holds a run of 21 words all the same, the runs of 6 have 11 words at most.
    assert set(got) == {1, 2, 3} and got[1]["changed_slots"] == 0 and got[2]["changed_slots"] > 0 and got[3]["run_words"] == 21


def test_op8_planted(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(k, i) for k, t in texts.items() for i, b in items.items() if f" {plain(b)} " in f" {plain(t)} "}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op8")} == want


def test_op1_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from factweave.llm.attention_mil import op1

    got = op1(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] <= got[2] <= 1


def test_op4_held_out(spark):
    from factweave.llm.word_backoff import op4

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert op4(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_op5_rules(spark):
    for r in run(spark, "op5"):
        fits = [(h + p, v) for v, h, p in url_rules.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == max(fits, key=lambda x: len(x[0])) if fits else r["rule"] is None


def test_op5_mined_rules(spark):
    rows = [(["h:spam", "s:x"], "block")] * 30 + [(["h:good", "s:x"], "allow")] * 50
    got = {tuple(r["items"]): r["verdict"] for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert got == {("h:spam",): "block", ("h:good",): "allow"}


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), [len(texts)]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        assert name == "encoding" or docs.columns == columns
        if name == "near_dedup":
            assert all(x[2] for x in classes({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80).values())
        if name == "personal_data":
            assert not any(pii_votes.base_spans(r["text"]) for r in docs.collect())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[-1] == sizes[-2]
