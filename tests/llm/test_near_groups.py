"""Components of near copies against brute force: groups alike at every degree, small tiles, few common shingles."""

import random

import numpy as np
import pytest

from weftlist.llm import jaccard_join

rng = random.Random(11)
VOCAB = [f"v{i}" for i in range(3000)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def variant(words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice(VOCAB)
    return " ".join(out)


def corpus():
    texts = []
    for n in (6, 25, 120, 400):
        base = [rng.choice(VOCAB) for _ in range(n)]
        texts += [variant(base, rng.randrange(1 + n // 12)) for _ in range(60)]
    boiler = " ".join(rng.choice(VOCAB) for _ in range(30))
    texts += [boiler + " " + " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(40))) for _ in range(90)]
    return texts + texts[:20]


@pytest.mark.parametrize("tile, common", [(2048, 250_000), (7, 0), (7, 20)])
def test_components(spark, monkeypatch, tile, common):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", tile)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    texts = corpus()
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: top(i) for i in range(len(texts))}


def test_certain_signatures():
    """Two sets within distance k share as many signatures as each of them claims."""
    r = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for n in (1, 4, 9, 30, 120, 500):
        for _ in range(40):
            a = np.unique(r.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64))
            drop = r.integers(0, max(len(a) // 7, 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(1, 2**63, r.integers(0, len(a) // 7 + 1), dtype=np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            sig, row, shared, deep = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), none)
            common = len(np.intersect1d(sig[row == 0], sig[row == 1]))
            least = max(shared) if not deep.any() else min(shared) if deep.all() else shared[~deep][0]
            assert common >= least > 0


def test_tile_counts():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(70)]
    value, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    left, right = np.arange(0, 40), np.arange(25, 70)
    got = jaccard_join.shared_counts(value, bounds, left, right)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    off = left[:, None] != right[None, :]
    assert (got[off] == np.array(want)[off]).all()
