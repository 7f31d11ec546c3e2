"""Interval joins and NEAR on the index against brute force."""

import random

import pytest

from textloom.operators import intervals
from textloom.operators.search import documents_of
from textloom.plans import query as q
from textloom.plans.compile import Options
from textloom.store.index import build_index

KIND = "doc_id long, start int, end int, name string"


@pytest.mark.parametrize("reach,overlap", [(0, False), (7, False), (1000, False), (0, True)])
def test_pairs_against_brute_force(spark, monkeypatch, reach, overlap):
    monkeypatch.setattr(intervals, "BUCKET", 16)
    pick = random.Random(reach)
    rows = lambda n, name: [(pick.randrange(3), s, s + pick.choice([0, 1, 5, 40]), f"{name}{i}") for i in range(n) for s in [pick.randrange(300)]]
    left, right = [*rows(60, "a"), (None, 1, 2, "x"), (1, None, 2, "x")], [*rows(60, "b"), (None, 1, 2, "y"), (1, 3, None, "y")]
    got = intervals.near_pairs(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), ["doc_id"], reach, overlap)
    whole = lambda r: None not in r
    close = lambda a, b: a[1] < b[2] and b[1] < a[2] if overlap else max(0, b[1] - a[2], a[1] - b[2]) <= reach
    want = sorted((a[3], b[3]) for a in filter(whole, left) for b in filter(whole, right) if a[0] == b[0] and close(a, b))
    assert sorted((r["l_name"], r["r_name"]) for r in got.collect()) == want and want


TEXTS = ["red fox and red cat", "red " + "x " * 30 + "fox", "Fox, the réd! fox red", "the red fox sees the red cat near the fox", "red red red", "", None, "fox\n\nred cat " * 40, "red fox of the cat", "xred foxy cat"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    raw = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return build_index(documents_of(raw), f"file://{tmp_path_factory.mktemp('near')}/i")


def brute_near(terms, chars):
    """Occurrences of each term with one of every other within so many characters; overlapping ones count once."""
    import re

    from textloom.functions.text import fold_text

    out = {}
    for i, text in enumerate(TEXTS):
        folded = fold_text(text or "")
        places = [[m.span() for m in re.finditer(r"(?<!\w)" + r"\W+".join(t.split()) + r"(?!\w)", folded)] for t in terms]
        full = {a for k, own in enumerate(places) for a in own if all(any(max(0, b[0] - a[1], a[0] - b[1]) <= chars for b in other) for j, other in enumerate(places) if j != k)}
        n, end = 0, -1
        for s, back in sorted((s, -e) for s, e in full):
            if s >= end:
                n, end = n + 1, -back
        if n:
            out[i] = n
    return out


@pytest.mark.parametrize("text,terms,chars", [("red NEAR:10 fox", ["red", "fox"], 10), ("red NEAR:100 fox", ["red", "fox"], 100), ("red NEAR:8 fox NEAR:30 cat", ["red", "fox", "cat"], 8), ('"the red" NEAR:40 fox', ["the red", "fox"], 40), ('"the red" NEAR:5 red', ["the red", "red"], 5)])
def test_near_counts(index, text, terms, chars):
    got = {r["doc_id"]: r["matches"] for r in index.matches(q.parse(text)).collect()}
    assert got == brute_near(terms, chars) and got


def test_near_among_other_clauses(index):
    listed = lambda text, **o: {r["doc_id"]: r["matches"] for r in index.matches(q.parse(text), Options(**o)).collect()}
    near = brute_near(["red", "fox"], 10)
    assert listed("cat red NEAR:10 fox") == {i: n + TEXTS[i].split().count("cat") for i, n in near.items() if "cat" in TEXTS[i].split()}
    assert set(listed("red -red NEAR:10 fox")) == {i for i, t in enumerate(TEXTS) if "red" in (t or "").lower().replace("é", "e").split() and i not in near} | ({1, 4} - set(near))
    assert set(listed("NOT red NEAR:10 fox")) == set(range(len(TEXTS))) - set(near)
    assert listed("absent OR red NEAR:10 fox") == near and listed("!! NEAR:5 red") == {}


def test_occurrences_are_places_of_the_folded_text(index):
    from textloom.functions.text import fold_text
    from textloom.store.index import _asked

    for r in index.occurrences([_asked(q.Word("red"), Options(), False), _asked(q.Phrase("red fox"), Options(), False)]).collect():
        shown = fold_text(TEXTS[r["doc_id"]])[r["start"] : r["end"]]
        assert shown == "red" if r["term"] == 0 else shown in ("red fox", "red! fox")
