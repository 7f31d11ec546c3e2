"""The exact join of shingle sets against brute force, and what it compares where many texts share a passage."""

import random

import numpy as np
import pytest

from textloom.operators import dupes, setjoin

KEYS = "k long, text string"


def words(n, seed):
    pick = random.Random(seed)
    return [f"w{pick.randrange(10**9)}" for _ in range(n)]


def brute(texts, threshold=0.8):
    sets = [set(setjoin.shingle_set(t).tolist()) for t in texts]
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}


def partition(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def connected(spark, texts, monkeypatch=None, counts=None):
    rows = spark.createDataFrame(list(enumerate(texts)), KEYS)
    if monkeypatch:
        plain = setjoin._still_apart
        monkeypatch.setattr(setjoin, "_still_apart", lambda mixed, threshold: counts.append(plain(mixed, threshold).count()) or plain(mixed, threshold))
    return {(min(r), max(r)) for r in map(tuple, setjoin.connecting_pairs(rows, dupes.components, 0.8).collect())}


def sharing(n, own, whole=200, seed=0, block=None):
    """Texts with one passage in common and ``own`` words each; ``block``: so many texts also have these in common."""
    passage = words(whole - own, seed)
    return [" ".join(words(own, (seed, i if block is None else i // block).__hash__()) + passage) for i in range(n)]


@pytest.mark.parametrize("own", [22, 26, 32, 50])
def test_a_shared_passage_is_not_compared_in_pairs(spark, monkeypatch, own):
    """Texts that share 75 to 89 % of their words and reach 0.8 in no pair: no more candidates than texts."""
    texts, counts = sharing(300, own), []
    assert not brute(texts[:20])
    assert connected(spark, texts, monkeypatch, counts) == set()
    assert counts == [0]


def test_connections_are_those_of_all_pairs(spark):
    """Groups of near copies, chains, and groups that share a passage with others, on both sides of the threshold."""
    pick, texts = random.Random(5), []
    for seed in range(4):
        base = words(120, 100 + seed)
        for changed in (0, 1, 2, 3, 4, 5, 6, 8):
            own = list(base)
            for at in pick.sample(range(120), changed):
                own[at] = f"new{pick.randrange(10**9)}"
            texts.append(" ".join(own))
        texts += sharing(12, 10 + 4 * seed, 120, seed, block=3) + [" ".join(base[:100]), " ".join(base[5:]), " ".join(base + words(14, seed)), ""]
    want, got = brute(texts), connected(spark, texts)
    assert got <= want
    assert partition(got, len(texts)) == partition(want, len(texts))


def test_altered_copies_without_their_source_are_no_candidates(spark, monkeypatch):
    """Copies of a text that is missing, each altered in places of its own: alike in no pair, though their prefixes meet."""
    pick, base, texts, counts = random.Random(2), words(230, 7), [], []
    for i in range(120):
        own = list(base)
        for at in pick.sample(range(230), 5):
            own[at] = f"new{i}x{at}"
        texts.append(" ".join(own))
    want = brute(texts)
    assert len(want) < 30
    assert partition(connected(spark, texts, monkeypatch, counts), 120) == partition(want, 120)
    assert counts[0] < 400  # of 7140 pairs


def test_parities_bound_the_difference(spark):
    sets = {k: set(random.Random(k).sample(range(-10**18, 10**18), 300)) for k in range(3)}
    sets[1] = set(list(sets[0])[:260]) | set(list(sets[1])[:30])
    rows = spark.createDataFrame([(k, h) for k, own in sets.items() for h in own], "k long, h long")
    bits = {r["k"]: [w % 2**64 for w in r["bits"]] for r in setjoin._parities(rows).collect()}
    for k, own in sets.items():
        want = [0] * 16
        for h in own:
            want[h & 15] ^= 1 << ((h >> 4) & 63)
        assert bits[k] == want
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b]))
    assert all(apart(a, b) <= len(sets[a] ^ sets[b]) for a in sets for b in sets) and 50 < apart(0, 1) <= 70 + 40


def test_prefixes_of_all_shingles(spark):
    """``pos`` is the number of a text's shingles before a shared one in the order of frequency and hash."""
    texts = [" ".join(words(30, i) + words(20, 99)) for i in range(5)] + [" ".join(words(30, 1))]
    rows = spark.createDataFrame(list(enumerate(texts)), KEYS)
    sets = setjoin._sets(rows, 5)
    got = setjoin._complete_prefixes(rows.select("k"), sets, 0.5)
    every = [setjoin.shingle_set(t) for t in texts]
    df = dict(zip(*np.unique(np.concatenate(every), return_counts=True)))
    want = set()
    for k, own in enumerate(every):
        order = sorted(own.tolist(), key=lambda h: (df[h], h))
        want |= {(h, k, len(own), at) for at, h in enumerate(order) if df[h] > 1 and at <= len(own) - int(np.ceil(0.5 * len(own)))}
    assert set(map(tuple, got.select("h", "k", "n", "pos").collect())) == want and "bits" in got.columns


def test_nothing_and_nulls(spark):
    assert connected(spark, []) == set()
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " a b "), (4, "A B")], KEYS)
    got = {(min(r), max(r)) for r in map(tuple, setjoin.connecting_pairs(rows, dupes.components, 0.8).collect())}
    assert got == {(1, 2), (3, 4)}


def test_unlike_candidates_are_dropped_before_sets_are_sent(spark):
    from textloom.operators import setjoin

    rows = [(1, list(range(0, 3200, 16))), (2, list(range(0, 3184, 16))), (3, list(range(16, 6400, 32)))]
    sets = spark.createDataFrame([(k, len(h), h) for k, h in rows], "k long, n int, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(r) for r in setjoin._alike_candidates(pairs, sets, 0.8).collect()] == [(1, 2)]
