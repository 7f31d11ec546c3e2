"""Vector searches of several questions, and their fusion with words."""

import numpy as np

from textloom.operators import meaning


def vectors(spark, n, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(n, 8)).tolist())]
    return rows, spark.createDataFrame([*rows, (None, [1.0] * 8), (n, None), (n + 1, [0.0] * 8)], "id long, embedding array<double>")


def order(rows, question, kept):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    return sorted(kept, key=lambda i: (-round(float(x[question] @ x[i]), 6), i))


def test_filters_come_before_the_nearest(spark):
    """Every question gets as many neighbours as pass the filter, fused with the words that pass it."""
    rows, table = vectors(spark, 60)
    kept = [i for i in range(60) if i % 4 == 1]
    words = [(5, 9.0), (13, 9.0), (4, 50.0), (200, 3.0), (17, 2.0)]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = meaning.composed_search(spark.createDataFrame(words, "id long, score double"), table, table.where("id % 20 = 0"), frame([*kept, 200, 200]), "id", most=10).collect()
    for question in (0, 20, 40):
        near = {i: k for k, i in enumerate(order(rows, question, kept)[:10], 1)}
        listed = {5: 1, 13: 2, 200: 3, 17: 4}
        want = {i: (sum(1 / (60 + ranks[i]) for ranks in (listed, near) if i in ranks), i not in listed) for i in {*near, *listed}}
        have = {r["id"]: (r["score"], r["only_meaning"]) for r in got if r["question"] == question}
        assert have.keys() == want.keys() and all(abs(have[i][0] - want[i][0]) < 1e-12 and have[i][1] == want[i][1] for i in want)
    none = meaning.composed_search(spark.createDataFrame(words, "id long, score double"), table, table.where("id < 0"), frame(kept), "id")
    assert none.count() == 0


def test_cuts_and_best_passages_of_each_question(spark):
    rows = [(0, "a", 1, 0.9), (0, "a", 2, 0.9), (0, "b", 3, 0.3), (1, "a", 1, 0.4), (1, "b", 4, 0.35), (2, "c", 5, 0.1)]
    found = spark.createDataFrame(rows, "question long, doc string, passage long, score double")
    best = meaning.best_passage(found, ["question", "doc"], "passage")
    assert sorted((r["question"], r["doc"], r["passage"]) for r in best.collect()) == [(0, "a", 1), (0, "b", 3), (1, "a", 1), (1, "b", 4), (2, "c", 5)]
    cut = meaning.relative_cut(found, 0.1, 0.2, by="question")
    assert sorted((r["question"], r["passage"]) for r in cut.collect()) == [(0, 1), (0, 2), (1, 1), (1, 4)]
