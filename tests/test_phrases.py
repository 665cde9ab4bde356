"""The automaton of phrases against one expression a phrase."""

import random
import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import text as X
from notemill.operators import phrases, terms


def made(r, n, least, most, letters="aab  -é.AB1$"):
    return ["".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("seed,most", [(0, 10**6), (1, 10**6), (2, 40)])
def test_rewrite_equals_the_fold(spark, monkeypatch, seed, most):
    """Random rules that make and break each other's matches, equal ones among them, in one part and in several."""
    monkeypatch.setattr(phrases, "MOST_BYTES", most)
    r = random.Random(seed)
    rules = [(v, t) for v, t in zip(made(r, 30, 1, 4), made(r, 30, 0, 4))]
    rules += [(v.upper(), "x" + t) for v, t in rules[:5]]
    texts = [None, "", *made(r, 400, 1, 60)]
    notes = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    text, applied = X.prepass(F.col("text"), rules)
    both = phrases.rewrite(notes, rules).withColumns({"t": text, "a": applied}).collect()
    assert sum(bool(x.a) for x in both) > 300
    for x in both:
        if x.text is not None:
            assert x.rewritten.text == x.t and [tuple(y) for y in x.rewritten.applied] == [tuple(y) for y in x.a], x.text
        else:
            assert x.rewritten.text is None and x.rewritten.applied == []


def test_standardise_is_the_same_with_many_rules(spark, monkeypatch):
    rules = [("b p now", "BP"), ("BP high", "hypertension"), ("met formin", "Metformin"), ("formin", "Form")]
    notes = spark.createDataFrame([("Met formin; B P now high, formin",), (None,), ("none",)], "text string")
    few = [x.asDict(True) for x in terms.standardise(notes, rules).collect()]
    monkeypatch.setattr(terms, "MOST_NATIVE", 0)
    assert [x.asDict(True) for x in terms.standardise(notes, rules).collect()] == few and few[0]["standard"] == "Metformin; hypertension, Form"


@pytest.mark.parametrize("most", [10**6, 30])
def test_scan_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_BYTES", most)
    r = random.Random(5)
    known = [p for p in made(r, 40, 1, 5) if p] + ["aab", "AAB"]
    texts = [None, "", "a" * 100_000, *made(r, 200, 1, 50)]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string").repartition(3)
    want = set()
    for p in {p.lower(): p for p in reversed(known)}.values():
        pattern = re.compile(f"(?<![A-Za-z0-9]){re.escape(p)}(?![A-Za-z0-9])", re.I)
        want |= {(i, p, m.start(), len(p)) for i, t in enumerate(texts) if t for m in pattern.finditer(t)}
    got = [tuple(x) for x in phrases.scan(notes, known).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    assert phrases.scan(notes, []).isEmpty()


def test_cost_hangs_on_hits_not_on_rules():
    """A hundred thousand rules: a text is read once, however many they are."""
    r = random.Random(1)
    many = ["".join(r.choice("abcdefghij") for _ in range(9)) + " x" for _ in range(100_000)]
    big, small = phrases.Automaton(many), phrases.Automaton(many[:10])
    text = " ".join(r.choice(many[:10] + ["word"] * 90) for _ in range(2_000))
    assert big.rewrite(text, ["T"] * len(many))[0] == small.rewrite(text, ["T"] * 10)[0]
