"""Clustering, whitening and toxicity against plain rounds, numpy and confirmed labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import drake_clusters, pu_toxicity, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, cluster string, n string, near string"


def vectors(spark, rows):
    """Rows with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], VECTORS)


def grouped_vectors(n, seed=0, d=64):
    """Normal vectors around a few centres, in single precision; every ninth repeats the one before."""
    r = np.random.default_rng(seed)
    v = (r.normal(size=(7, d))[r.integers(0, 7, n)] + r.normal(size=(n, d)) * r.choice([0.01, 0.2, 0.6], n)[:, None]).astype(np.float32)
    v[8::9] = v[7::9][: len(v[8::9])]
    return v.tolist()


ODD = [(None, [0.5] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [1.0] * 63 + [float("inf")]), (906, [1.0] * 65), (7, [0.25] * 64)]


def plain_rounds(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, at) in zip(kept, found) if at == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    whole = sum(d for d, _ in found)
    inertia = {j: sum(d for d, at in found if at == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], whole, sha[j]) for (i, _), (d, j) in zip(kept, found))


def clustered(frame):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in drake_clusters.cluster_report(frame).collect())


@pytest.mark.parametrize("n", [3, 300])
def test_clusters_against_plain_rounds(spark, n):
    rows = list(enumerate(grouped_vectors(n))) + ODD
    assert clustered(vectors(spark, rows).repartition(5)) == plain_rounds(rows)


def test_clusters_of_nothing(spark):
    assert clustered(vectors(spark, [])) == [] and clustered(vectors(spark, ODD[1:4])) == []
    same = [(i, [0.5] * 64) for i in range(90)]  # all centroids are equal, so the first takes everything
    assert clustered(vectors(spark, same)) == plain_rounds(same) and {r[1] for r in plain_rounds(same)} == {0}
    with pytest.raises(Exception, match="too large"):
        clustered(vectors(spark, [(1, [1e30] * 64)]))


def test_bounds_spare_distances_and_stay_true():
    """After a few rounds most vectors are certain by their bounds, and no bound is above a true distance."""
    x = np.floor(np.array(grouped_vectors(2000, 3)) * 256).astype(np.int64)
    c, state, spared = x[:40].copy(), None, []
    moved = drake_clusters.Moved(c, np.zeros(40), 10)
    for _ in range(8):
        near, distance, low, used = drake_clusters.assign_block(x, moved, state)
        true = drake_clusters._distances(x, moved.centroids)
        assert (distance == true.min(1)).all() and (near[:, 0] == true.argmin(1)).all()
        for b in range(near.shape[1] - 1):
            assert (low[:, b] <= np.sqrt(true[np.arange(len(x)), near[:, b + 1]])).all()
        others = true.astype(float)
        np.put_along_axis(others, near, np.inf, 1)
        assert (low[:, -1] <= np.sqrt(others.min(1))).all()
        spared.append((used == 0).mean())
        c = np.array([x[near[:, 0] == j].sum(0) // max(1, (near[:, 0] == j).sum()) if (near[:, 0] == j).any() else moved.centroids[j] for j in range(40)])
        moved = drake_clusters.Moved(c, np.sqrt(((c - moved.centroids) ** 2).sum(1)) * (1 + 1e-9), max(5, moved.kept - 1))
        state = near, low
    assert spared[0] == 0 and spared[-1] > 0.5


# --- whitening ---------------------------------------------------------------------------------


def whitened(frame, most=32):
    return {(str(r["vec_id"]), r["component"]): r for r in whitening.whitening_report(frame, most=most).collect()}


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # so that moments are merged in several stages
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = list(enumerate(grouped_vectors(400, 1))) + [r for r in ODD if r[0] not in (7,)]
    got = whitened(vectors(spark, rows).repartition(9))
    kept = [(str(i), v) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(0)
    mean = s / n
    values, axes = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - mean) @ axes[:, :32] / np.sqrt(values[:32])
    have = np.array([[got[i, c + 1]["whitened"] for c in range(32)] for i, _ in kept])
    assert len(got) == 32 * n and np.abs(np.abs(have) - np.abs(want)).max() < 1e-6
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-6
    for i, (name, _) in enumerate(kept):
        r = got[name, 1]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
    assert all(abs(got["0", c + 1]["explained"] - values[c] / values.sum()) < 1e-9 for c in range(32))
    assert 0 <= got["0", 1]["identity_error"] < 1e-9


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitened(vectors(spark, [])) == {} and whitened(vectors(spark, ODD[1:3])) == {}
    assert whitened(vectors(spark, [(i, [0.5] * 64) for i in range(5)])) == {}
    got = whitened(vectors(spark, list(enumerate(grouped_vectors(6, 2)))))  # five directions at most
    assert {c for _, c in got} == {1, 2, 3, 4, 5} and got["0", 1]["identity_error"] < 1e-6


def test_symmetric_qr():
    r = np.random.default_rng(0)
    for d in (1, 2, 3, 10, 64):
        for a in (r.normal(size=(d, d)), np.diag(r.integers(0, 3, d)).astype(float), np.zeros((d, d)), np.ones((d, d))):
            a = a + a.T
            values, axes = whitening.symmetric_qr(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10) and np.allclose(axes @ axes.T, np.eye(d), atol=1e-10)
            assert np.allclose(axes * values @ axes.T, a, atol=1e-9)


def test_updates_and_merges_are_one():
    """Rank-one updates one at a time, in blocks, and merged parts have the moments of the whole, far from the origin."""
    x = np.random.default_rng(1).integers(0, 50, (500, 8)) + 1_000_000_000
    apart = (x - x.sum(0) // 500) - (x.sum(0) % 500) / 500
    one, parts = whitening.Moments.none(8), [whitening.Moments.none(8) for _ in range(3)]
    for row in x:
        one.add(row[None])
    for m, part in zip(parts, np.split(x, [10, 200])):
        m.add(part)
    merged = parts[0].merge(parts[1]).merge(whitening.Moments.none(8)).merge(parts[2])
    for m in (one, merged):
        assert m.sums == x.sum(0).tolist() and m.n == 500
        assert np.allclose(m.products, apart.T @ apart, rtol=1e-6, atol=1e-3)


def test_large_deviations_are_exact():
    project = whitening.Projection(3, (3 << 33, 1), np.eye(2))
    x = np.array([[1 << 33, 0], [(1 << 33) + 400_000_000, 5]])
    assert project.deviations(x).tolist() == [1, (3 * 400_000_000) ** 2 + 14**2]
    with pytest.raises(OverflowError):
        project.deviations(np.array([[1 << 40, 0]]))


# --- toxicity ----------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, source string, id string, h string, score string, positive string"
LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def toxic_corpus(n, seed=0):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    bad = ["scum", "rubbish", "Vermin"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [pick.choice(vocabulary) for _ in range(30)], pick.random() < 0.2
        if toxic:
            words[pick.randrange(30)] = pick.choice([*bad, "blatto" + pick.choice("abcdef") * 2])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], TEXTS)


def test_held_out_toxicity(spark):
    rows, labels = toxic_corpus(3000)
    # labels of held-out rows are wrong on purpose: they must not matter
    told = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    docs = docs_of(spark, rows + [(None, None), (None, "scum of rubbish"), (-1, ""), (-2, "scum " * 300_000), (-2, "scum " * 300_000)])
    got = pu_toxicity.toxicity(docs, spark.createDataFrame(told + [(None, 1, 1), (5, 1, None)], LABELS)).collect()
    assert len(got) == 3005 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth, found = {i: t for i, _, t in labels}, {r["doc_id"]: r for r in got if r["doc_id"] in range(3000)}
    assert all(r["held_out"] == held(i) for i, r in found.items())
    tests = [i for i in found if held(i)]
    hit = sum(found[i]["predicted"] for i in tests if truth[i])
    assert hit >= 0.95 * sum(truth[i] for i in tests) and sum(found[i]["predicted"] for i in tests) <= 1.1 * hit
    odd = [r for r in got if r["doc_id"] not in range(3000)]
    assert sorted(r["predicted"] for r in odd) == [0, 0, 1, 1, 1] and not any(r["held_out"] for r in odd if r["doc_id"] is None)


def test_labels_that_are_held_out_teach_nothing(spark):
    rows, labels = toxic_corpus(400)
    scores = [sorted(map(tuple, pu_toxicity.toxicity(docs_of(spark, rows), spark.createDataFrame(told, LABELS)).collect())) for told in (labels, [r for r in labels if not held(r[0])])]
    assert scores[0] == scores[1]


def test_toxicity_without_examples(spark):
    rows, labels = toxic_corpus(20)
    clean = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    for told in (clean, clean.limit(0)):
        assert {(r["score"], r["predicted"]) for r in pu_toxicity.toxicity(docs_of(spark, rows), told).collect()} == {(0.001, 0)}
    assert pu_toxicity.toxicity(docs_of(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_samples_are_bounded(spark):
    rows, labels = toxic_corpus(500)
    toxic, share = pu_toxicity.confirmed(spark.createDataFrame(labels, LABELS))
    kept = pu_toxicity.sample(docs_of(spark, rows), toxic, "doc_id", "text", 20, 100).collect()
    assert sum(r["positive"] for r in kept) == 20 and sum(not r["positive"] for r in kept) == 100
    assert len({r["h"] for r in pu_toxicity.sample(docs_of(spark, rows[:9] * 50), toxic, "doc_id", "text", 20, 100).collect() if not r["positive"]}) == sum(not held(i) for i in range(9))
    assert abs(share - np.mean([t for i, _, t in labels if not held(i)])) < 1e-12


def test_risk_is_corrected_and_not_negative():
    """One feature that all toxic texts and none of the others have: unlabelled texts are toxic in the prior's share."""
    positive = np.array([True] * 50 + [False] * 200)
    sizes = np.array([1] * 50 + [1] * 40 + [0] * 160)
    w, bias = pu_toxicity.nn_pu_fit(np.zeros(90, np.int64), sizes, positive, 1, 0.2)
    p = lambda g: 1 / (1 + np.exp(-g))
    assert p(w[0] + bias) > 0.9 and p(bias) < 0.1
    # without the correction the same texts would be toxic with the odds of 50 to 40
    rare, _ = pu_toxicity.nn_pu_fit(np.zeros(90, np.int64), sizes, positive, 1, 0.02)
    assert rare[0] < w[0]
    index, sizes = np.arange(50), np.array([1] * 50 + [0] * 200)  # each toxic text has a word of its own, so the estimate is negative
    w, bias = pu_toxicity.nn_pu_fit(index, sizes, positive, 50, 0.2, steps=300)
    g = np.concatenate([w + bias, np.full(200, bias)])
    negative = np.logaddexp(0, g[50:]).mean() - 0.2 * np.logaddexp(0, g[:50]).mean()
    assert negative > -0.2 and np.isfinite(w).all()


def test_words_of_long_texts():
    text = " ".join(f"Wort{i}é" for i in range(200_000)).replace("1", "a")
    assert pu_toxicity.words_of(text) == set(text.encode().translate(pu_toxicity._WORDS_ONLY).split())
    assert pu_toxicity.words_of(None) == set() and pu_toxicity.words_of("Ab-c1D Ü") == {b"ab", b"c", b"d", "Ü".encode()}
