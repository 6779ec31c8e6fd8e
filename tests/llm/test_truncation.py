from __future__ import annotations

import random

import pytest

from dyadica.llm.truncation import limits, per_source, tails, truncated

SCHEMA = "doc_id bigint, source string, text string, t string, z string, n int"
NOUNS = ["harbour", "budget", "committee", "railway", "library", "fishery", "hospital", "committees", "regulation", "province"]
VERBS = ["approved", "delayed", "defended", "published", "rejected"]
TAILS = ["last autumn", "without a vote", "before the recess", "in the second reading"]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(TAILS)}."


def corpus(n=700, seed=0):
    """Speeches, of which some are cut at 300 characters (feed) or anywhere (wire); the cut ones' ids."""
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 7)))
        source = rng.choice(["feed", "wire", "scan", None])
        if source == "feed" and len(text) > 300:
            if text[:300].rstrip()[-1] != ".":
                cut.add(i)
            text = text[:300]
        elif source == "wire" and rng.random() < 0.15:
            k = rng.randrange(40, len(text))
            if text[:k].rstrip()[-1] == ".":
                k -= 3
            text = text[:k]
            cut.add(i)
        elif source == "scan":
            text += rng.choice(["", "\n- 12 -", " \n[p. 4]", "  "])
            if rng.random() < 0.2:
                text = text.replace(".\n", "\n") if "\n" in text else text[:-1].rstrip(".")  # whole, without a full stop
        rows.append((i, source, text))
    return rows, cut


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "z", 1) for r in rows], SCHEMA)


def test_planted_cuts(spark):
    rows, cut = corpus()
    found = {r["doc_id"] for r in truncated(frame(spark, rows)).collect()}
    assert len(cut) > 80
    assert len(found & cut) >= 0.95 * len(cut)
    assert len(found - cut) <= 0.03 * len(found)


def test_limits(spark):
    rows, _ = corpus()
    assert [(r["source"], r["unit"], r["size"]) for r in limits(frame(spark, rows)).collect()] == [("feed", "chars", 300)]


def test_cases(spark):
    rows, _ = corpus(400, 3)
    base = [(i + 1000, "scan", t) for i, _, t in rows]
    cases = [
        (1, "wire", "The harbour approved the budget of the prov", True),
        (2, "wire", "The harbour approved the budget of the", True),
        (3, "wire", "The harbour approved the budget last autumn", False),
        (4, "wire", "The harbour approved the budget of the province –", False),
        (5, "wire", "The harbour approved the budget last autumn. (The committee", True),
        (6, "wire", "The harbour approved the budget of the com\n- 14 -", True),
        (7, "wire", "The harbour approved the budget last autumn.\n- 14 -", False),
        (8, "wire", "The harbour approved the budget of the com <para id=", True),
        (9, "wire", "The harbour approved the budget of the com�", True),
        (10, "wire", "The harbour approved the budget,", True),
        (11, "wire", "The harbour approved the budget last autumn... (Interruption)", False),
        (12, "wire", "", False),
        (13, "wire", None, False),
        (14, "wire", "  \n", False),
        (15, "wire", "!?", False),
        (20, "wire", "((", False),
        (16, None, "The harbour approved the budget of the com", True),
        (17, "wire", "The harbour approved the budget of the com", True),
        (18, "wire", "The harbour approved the budget of the com   ​\n", True),
        (19, "wire", "Library", False),
        (None, "wire", "The harbour approved the budget of the regula", True),
    ]
    found = {r["doc_id"] for r in truncated(frame(spark, base + [c[:3] for c in cases])).collect()}
    assert {c[0] for c in cases if c[3]} == {d for d in found if d is None or d < 1000}


def test_copies_are_no_counter_witnesses(spark):
    rows, _ = corpus(400, 3)
    rows = [(i + 1000, "scan", t) for i, _, t in rows]
    rows += [(i, "wire", "The library rejected the budget last autumn. The harbour approved the budget of the") for i in range(60)]
    rows += [(100 + i, "wire", "The railway delayed com" + " " * i) for i in range(6)]
    rows += [(200 + i, "wire", "The budget of the library") for i in range(10)]  # a heading
    found = {r["doc_id"] for r in truncated(frame(spark, rows)).collect()}
    assert {d for d in found if d < 1000} == {*range(60), *range(100, 106)}


def test_shares(spark):
    rows, cut = corpus(300, 5)
    s = {r["source"]: r for r in per_source(frame(spark, rows)).collect()}
    assert set(s) == {"feed", "wire", "scan", None} and sum(r["texts"] for r in s.values()) == 300
    assert s["wire"]["truncated"] > 0 and 0 < s["wire"]["share"] < 0.5


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, "a", "")]])
def test_nothing(spark, rows):
    df = frame(spark, rows)
    assert truncated(df).count() == 0 and per_source(df).count() == 0 and tails(df).count() == 0


def test_very_long_text(spark):
    text = "The harbour approved the budget last autumn. " * 20_000
    rows = [(1, "x", text + "The harbour approved the bud"), (2, "x", text), (3, "x", "y" * 1_000_000)]
    rows += [(10 + k, "x", t + ".") for k, t in enumerate(["1," * 300_000 + "1", " " * 1_000_000 + "a", "(" * 200_000 + "a" + ")" * 200_000, "a: " * 200_000, "a- " * 200_000, "<" * 300_000, "&" * 300_000, "- 1 -\n" * 100_000, "…" * 300_000])]
    assert 1 in {r["doc_id"] for r in truncated(frame(spark, rows)).collect()} <= {1, 14}
