"""Passages of benchmark items that documents hold in part, in another place or in another case; all figures against a plain version."""

import random
from collections import defaultdict

import pytest

from factweave.llm import decontaminate

# 59 different words, none a name, number or unit.
ITEM = " ".join(f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "ne", "po", "ra") for b in ("dar", "fel", "gon", "hus", "jil", "kem", "lop", "nur"))
ITEM += " zabor wexil vutan"
OTHER = " ".join(f"un{a}{b}" for a in "bcdfgh" for b in ("arro", "elli", "immo"))


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")).collect()}


def test_a_long_quote_of_a_longer_item(spark):
    words = ITEM.split()
    assert len(words) == 59
    cut = lambda a, n: f"{OTHER} {' '.join(words[a : a + n])} {OTHER}"
    apart = f"{' '.join(words[:10])} {OTHER} {' '.join(words[20:30])}"
    got = found(spark, [cut(5, 30), cut(20, 13), cut(20, 12), apart, ITEM], [ITEM])
    assert set(got) == {(1, 1), (2, 1), (5, 1)}
    assert got[1, 1]["n_matched"] == 23 and got[1, 1]["run_words"] == 30 and got[1, 1]["coverage"] < 0.5
    assert got[2, 1]["run_words"] == 13 and got[5, 1]["run_words"] == 59


def test_first_words_case_and_short_items(spark):
    short = "What is the capital of France?"
    titled = "The old Harbour of Lisbon faces the Tower where the Captain of Madrid met Doctor Moreno near the Garden of Seville"
    docs = [
        "Geography quiz\nWhat is the capital of France?",  # the first word is inside a sentence here
        "quiz: what is the capital of france",  # in lower case
        "Geography quiz\nWhat is the capital of Spain?",  # another value
        "Geography quiz\nWhere is the capital of France?",
        f"{OTHER} {titled.lower()} {OTHER}",
        "so the answer, Two Plus Two; is known",  # an item of three words, in another case
        "so the answer is two plus three",
        "Two - ? -",
    ]
    got = found(spark, docs, [short, titled, "two plus two", "  ", None, "- ?"])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2), (6, 3)}
    assert got[3, 1]["changed_slots"] == 1 and got[1, 1]["changed_slots"] == got[2, 1]["changed_slots"] == got[6, 3]["changed_slots"] == 0
    assert got[5, 2]["coverage"] == 1


def shapes(text, width, item):
    """{place: [(what must be equal, what the slots hold)]} of each window of a text, or of an item with what it takes part with."""
    d = decontaminate
    words = d.words_of(text)
    _, slot, _, loose, inner = (x.tolist() for x in d.canonical(words, d.Tokens()))
    word = [w.strip(d.EDGES).lower().decode("utf-8", "replace") for w in words]
    out, strict_of, wide_of = {}, {}, {}
    for i in range(len(words) - width + 1):
        span = range(i, i + width)
        wide_of[i] = sum(slot[j] == 0 for j in span) >= min(d.LITERALS, width)
        strict_of[i] = sum(slot[j] == 0 or inner[j] for j in span) >= min(d.LITERALS, width)
    as_words = strict_of if any(strict_of.values()) else dict.fromkeys(strict_of, True)
    as_slots = wide_of if any(wide_of.values()) or any(strict_of.values()) else dict.fromkeys(wide_of, True)
    for i in wide_of:
        span, found = range(i, i + width), []
        as_word = {"template": set(), "first": {i}, "strict": {j for j in span if inner[j]}, "plain": set(span)}
        if width < d.SHORTEST:
            kinds = ["plain"]
        else:
            kinds = ["template"] + ["first"] * bool(loose[i]) + ["strict"] * (sum(map(bool, inner[i : i + width])) > bool(inner[i]) and sum(slot[j] > 0 for j in span) > sum(map(bool, inner[i : i + width]))) + ["plain"] * (sum(slot[j] > 0 for j in span) > bool(loose[i]))
        for kind in kinds:
            if item and not (as_slots if kind in ("template", "first") else as_words)[i]:
                continue
            key = tuple(word[j] if j in as_word[kind] or not slot[j] else (d.SLOT_TEXT[slot[j]],) for j in span)
            held = [f"{slot[j]}{word[j]}" for j in span if slot[j] and (j not in as_word[kind] or item and kind == "plain")]
            found.append((key, held, kind))
        out[i] = found
    counted = {i for i in wide_of if (as_slots if any(as_slots.values()) else as_words)[i]}
    return out, counted


def plain_result(docs, items):
    """{(doc_id, item_id): (n_matched, n_windows, run_words, changed_slots)} by meeting all windows of all pairs."""
    d, out, read = decontaminate, {}, {}
    for item_id, text in items:
        words = d.words_of(text)
        if not any(w.strip(d.EDGES) for w in words):
            continue
        width = min(d.WIDTH, len(words))
        own, counted = shapes(text, width, True)
        nth = {j: k for k, j in enumerate(j for j in sorted(own) if own[j])}
        at = defaultdict(list)
        for j in nth:
            for key, meant, kind in own[j]:
                at[key].append((j, meant, kind))
        for doc_id, doc in docs:
            if (doc_id, width) not in read:
                read[doc_id, width] = shapes(doc, width, False)[0]
            lines = defaultdict(lambda: (set(), set(), set()))
            for i, mine in read[doc_id, width].items():
                for key, filled, _ in mine:
                    for j, meant, kind in at.get(key, ()):
                        pairs = list(zip(meant, meant if kind == "plain" else filled))
                        line = lines[i - j]
                        line[0].add(j)
                        line[2].update(pairs)
                        if all(a == b for a, b in pairs):
                            line[1].add(j)

            def longest(places):
                most = first = 0
                for k, j in enumerate(sorted(places)):
                    before = sorted(places)[k - 1] if k else None
                    first = first if k and nth[j] == nth[before] + 1 and j <= before + width else j
                    most = max(most, j + width - first)
                return most

            held, run, changed = set(), -1, -1
            for whole, exact, slots in lines.values():
                if len(slots) == len({a for a, _ in slots}):
                    held |= whole & counted
                    run, changed = max(run, longest(whole)), max(changed, sum(a != b for a, b in slots))
                elif longest(exact) >= d.RUN:
                    held |= exact & counted
                    run, changed = max(run, longest(exact)), max(changed, 0)
            if run >= 0 and (len(held) >= d.LEAST * len(counted) or run >= d.RUN):
                out[doc_id, item_id] = (len(held), len(counted), run, changed)
    return out


def test_one_of_two_equal_values_edited(spark):
    item = " ".join(["In a hall stood 12 old chairs and near the wide door lay a long green carpet that nobody had moved for years while outside", "the grey horse of the miller drank from 12 buckets in turn"])
    assert len(item.split()) >= 36
    docs = [item, item.replace("12", "14"), item.replace("12 buckets", "14 buckets"), item.replace("12 old", "14 old"), "In a hall stood 12 old chairs. The grey horse drank from 14 buckets in turn"]
    got = found(spark, docs, [item])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)} and got[3, 1]["run_words"] >= 20 and got[3, 1]["changed_slots"] == 0 and got[2, 1]["changed_slots"] == 1
    assert {k: (r["n_matched"], r["n_windows"], r["run_words"], r["changed_slots"]) for k, r in got.items()} == plain_result(list(enumerate(docs, 1)), [(1, item)])


@pytest.mark.parametrize("seed", [1, 2])
def test_all_figures_against_a_plain_version(spark, seed):
    r = random.Random(seed)
    word = ["anna", "Bob", "the", "fox", "jumps", "over", "12", "7", "km", "hours", "Lisbon", "Moreno", "two.", "red", "and", "house", "ran", "(so)", "then", "-"]
    items = [" ".join(r.choice(word) for _ in range(n)) for n in (3, 6, 9, 14, 20, 26, 40)] + ["  ", "- ?"]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 4)):
            cut = r.choice(items).split()
            a = r.randrange(len(cut)) if cut else 0
            cut = cut[a : a + r.randint(4, 40)]
            cut = [r.choice(["99", "3", "Zora", "mia", "fox"]) if r.random() < 0.07 else w.lower() if r.random() < 0.05 else w for w in cut]
            parts += cut + [r.choice(word) for _ in range(r.randrange(6))]
        docs.append(" ".join(parts))
    got = found(spark, docs, items)
    want = plain_result(list(enumerate(docs, 1)), list(enumerate(items, 1)))
    assert {k: (x["n_matched"], x["n_windows"], x["run_words"], x["changed_slots"]) for k, x in got.items()} == want and len(want) > 20 and len({i for _, i in want}) > 3


def test_figures_of_the_tables_against_a_plain_version(spark):
    at = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"], r["run_words"], r["changed_slots"]) for r in decontaminate.contaminated(docs, items).collect()}
    short = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == plain_result([x for x in short if x[1]], [(r["item_id"], r["text"]) for r in items.collect()])
