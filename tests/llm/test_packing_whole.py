"""Plans of packing: many short pieces."""

import itertools
import random

import numpy as np

from weftlist.llm import packing
from weftlist.llm.queries import tokenizer_path


def check(histogram, capacity):
    """The number of sequences of a plan, all of whose pieces lie in a sequence once and end to end."""
    segments, n = packing.plan(histogram, capacity)
    ranks, rows = {}, [[] for _ in range(n)]
    for length, low, high, first, offset in segments:
        ranks.setdefault(length, []).extend(range(low, high))
        for j in range(high - low):
            rows[first + j].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    for row in rows:
        end = 0
        for offset, length in sorted(row):
            assert offset == end
            end += length
        assert 0 < end <= capacity
    return n


def test_many_short_pieces(spark):
    for histogram in ({1: 5000}, {2: 1000}, {1: 3000, 2: 1500, 700: 3}, {1: 4096, 2048: 2}):
        assert check(histogram, 2048) == -(-sum(k * v for k, v in histogram.items()) // 2048)
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text")
    rows = packing.pack(docs, tokenizer_path(), 2048).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 3000 and {r.sequence_id for r in rows} == {0, 1}


def test_filling_wastes_least():
    rng = random.Random(3)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for _ in range(rng.randrange(1, 6)):
            counts[rng.randrange(1, 31)] += rng.randrange(1, 3)
        room = rng.randrange(1, 31)
        pieces = [s for s in range(30, 0, -1) for _ in range(counts[s]) if s <= room]
        fits = [f for k in range(len(pieces) + 1) for f in itertools.combinations(pieces, k) if sum(f) <= room]
        assert packing.complete(counts, room, room) == list(max(fits, key=lambda f: (sum(f), f)))


def fewest(pieces, capacity):
    """The fewest sequences, by trying every place of every piece."""
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            k = rooms.index(room)
            go(i + 1, rooms[:k] + [room - pieces[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


def test_fewest_sequences():
    pieces = [1664, 1536, 1408, 896, 768, 384, 384, 256, 256, 256, 256, 128]
    assert check({s: pieces.count(s) for s in pieces}, 2048) == 4
    rng = random.Random(6)
    for _ in range(250):
        pieces = sorted((rng.randrange(1, rng.choice([8, 15, 21])) for _ in range(rng.randrange(1, 11))), reverse=True)
        counts = np.bincount(pieces, minlength=21)
        n = fewest(pieces, 20)
        assert packing.lower_bound(counts, 20) <= n == check({s: pieces.count(s) for s in pieces}, 20)


def test_search_ends(monkeypatch):
    rng = random.Random(2)
    histogram = {rng.randrange(500, 900): rng.randrange(1, 40) for _ in range(150)}
    counts = np.zeros(2049, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    monkeypatch.setattr(packing, "WORK", 20_000)
    assert check(histogram, 2048) <= sum(n for _, n in packing._best_fit(counts, 2048))
