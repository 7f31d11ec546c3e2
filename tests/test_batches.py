"""Rows that become many items, a few of which are held at a time."""

import pyarrow as pa

from textloom import session
from textloom.operators import matching, meaning
from textloom.plans import query as q


def test_items_of_long_texts_are_passed_on_in_parts(monkeypatch):
    """No batch that a task passes on is longer than the items of the row at which the limit is met."""
    monkeypatch.setattr(session, "ITEMS_AT_ONCE", 5)
    batch = pa.RecordBatch.from_pydict({"id": list(range(12)), "text": ["x " * i for i in range(12)]})
    made = list(session.exploded_batches([batch], 1, lambda text: [(n, w) for n, w in enumerate(text.split())], {"n": pa.int32(), "word": pa.string()}))
    assert max(b.num_rows for b in made) <= 5 + 11 and len(made) > 4
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == [(i, n, "x") for i in range(12) for n in range(i)]


def test_previews_and_passages_are_not_built_as_one_list(spark):
    docs = spark.createDataFrame([("s", "a", "a", "a", "the\nx\n" * 3), ("s", "b", "b", "b", None)], "site_id string, path string, file string, name string, body string")
    for made in (matching.preview_lines(docs, q.parse("the")), meaning.passages(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "ArrowEvalPython" not in plan
    assert sorted((r["path"], r["line"], r["text"], r["truncated"]) for r in matching.preview_lines(docs, q.parse("the")).collect()) == [("a", n, "⟦the⟧" if n % 2 else "x" if n < 7 else "", False) if n < 7 else ("a", 7, "", False) for n in range(1, 8)] + [("b", 1, "", False)]
    assert sorted((r["path"], r["passage"], r["text"]) for r in meaning.passages(docs).collect()) == [("a", 0, "a\nthe\nx\nthe\nx\nthe\nx"), ("b", 0, "b")]
