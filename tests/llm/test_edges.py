"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from factweave.llm import attention_mil, decontaminate, license_scan, near_duplicates, pii_votes, quality_trees, repeats, sentencepiece_rounds, url_rules, word_backoff

LONG = "word " * 30_000 + "Licensed under the Apache License, Version 2.0. mail a@b.com " + "x" * 3000
ROWS = [(1, None, None), (2, "", "en"), (3, LONG, "en"), (None, "the cat sat on the mat today", "en"), (4, "le chat est sur la table rouge", "fr"), (4, "le chat est sur la table rouge", "fr"), (5, " \n\t ", None), (6, "the cat sat on the mat today", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame([r + (0, "s", 1, 2) for r in ROWS], "doc_id long, text string, lang string, score int, spans string, k int, n_words int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score int, spans string, k int, n_words int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (4, 1, 0), (6, 1, None), (None, 1, 1), (1, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "what is seven plus the number of cats on the mat today sir"), (2, None), (3, "")], "item_id long, text string")


def operators(labels, items):
    return {
        "op1": lambda d: attention_mil.scored(d, attention_mil.fit(d, labels)),
        "op2": pii_votes.detect,
        "op3": license_scan.scan,
        "op4": lambda d: word_backoff.predicted(d, word_backoff.learn(d, F.lit(True))),
        "op6": lambda d: quality_trees.judge(d, quality_trees.fit(d, labels)),
        "op7": sentencepiece_rounds.encode,
        "op8": lambda d: decontaminate.contaminated(d, items),
        "op9": repeats.remove_repeats,
        "op10": near_duplicates.near_duplicates,
        "redact": pii_votes.redact,
    }


NAMES = ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "redact"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, items, name):
    got = operators(labels, items)[name](docs).collect()
    if name in ("op3", "op8"):
        assert all(r["doc_id"] is not None for r in got)
    else:
        assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 3, 4, 4, 5, 6]
    if name == "op3":
        assert [(r["doc_id"], r["license"]) for r in got] == [(3, "Apache-2.0")]
    if name == "op4":
        assert {r["doc_id"]: r["lang_pred"] for r in got}[2] == "und" and {r["doc_id"]: r["lang_pred"] for r in got}[4] == "fr"
    if name == "op10":
        assert all(r["kept"] for r in got) and {r["doc_id"]: r["component_id"] for r in got}[None] is None
    if name == "redact":
        assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in got}[3] and got[0]["k"] == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, items, name):
    assert operators(labels, items)[name](none).count() == 0


def test_nothing_to_learn(docs, labels):
    assert attention_mil.scored(docs, attention_mil.fit(docs, labels.limit(0))).count() == len(ROWS)
    assert quality_trees.judge(docs, quality_trees.fit(docs, labels.limit(0))).count() == len(ROWS)
    assert {r["lang_pred"] for r in word_backoff.predicted(docs, word_backoff.learn(docs, F.lit(False))).collect()} == {"und"}


def test_pages(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://X.Example.ORG/es/a?q=1"), (3, "http://X.Example.ORG/es/a?q=1"), (4, "https://a.com"), (5, "x://b.com/fr/#y"), (6, ""), (None, "http://notorg/"), (7, "http://org/"), (8, "http://xexample.org/en/1")]
    got = [tuple(r) for r in url_rules.judge(spark.createDataFrame([r + ("z",) for r in rows], "page_id long, url string, rule string")).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[3] == ("x.example.org", "/es/a", "example.org/es/", "block") and by[5] == ("b.com", "/fr/", "com/fr/", "allow")
    assert by[1] == by[2] == by[6] == ("", "", None, "allow") and by[4][:3] == ("a.com", "", None) and by[7] == ("org", "/", "org/", "allow")
    assert by[8] == ("xexample.org", "/en/1", "org/", "allow") and by[None][2] is None
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
