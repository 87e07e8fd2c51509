"""Anchors with more stretches than an array takes, periodic and wordless text, copies, and an empty table, against brute force."""

import random

import numpy as np
import pytest

from weftlist.llm import suffix_dedup


def gone_bytes(texts, length=200):
    data, seen = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(data):
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j : j + length], []).append((i, j))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if len(seen[b[j : j + length]]) > 1:
                gone[j : j + length] = True
        out.append(gone)
    return data, out


def check(spark, texts, split=suffix_dedup.SPLIT, ids=None):
    data, gone = gone_bytes(texts)
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    want = sorted((i if i is not None else -1, np.frombuffer(b, np.uint8)[~g].tobytes(), len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum())) for i, b, g in zip(ids, data, gone))
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, split=split).collect())
    assert got == want


@pytest.mark.parametrize("split", [2, 3, 4, 1000])
def test_split(spark, split):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(6):  # passages that some texts share: as many different stretches around each end
        passage = prose(300)
        texts += [prose(150) + passage + prose(150) for _ in range(4)]
    passage = prose(600)
    for _ in range(12):  # near copies
        t = list(passage)
        for _ in range(3):
            t[rng.randrange(600)] = "z"
        texts.append("".join(t))
    check(spark, texts, split)


def test_periods_and_edges(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdef") for _ in range(700))
    texts = ["-" * 3000, "ab" * 400 + "end", "x" + "-" * 200, "-" * 199, "=- " * 300, word, "q" + word[100:500] + "r", "long " + word[:90] + " " + word[:90] + " tail " * 60]
    texts += [None, "", "é" * 150, "é" * 150 + "!", "same " * 50 + word, "same " * 50 + word, "\x00" * 250 + "z", " " * 450]
    check(spark, texts)
    check(spark, texts, 2)
    check(spark, [*texts[:6], word, word, "other " + word], ids=[1, 2, 2, 3, 3, 4, None, None, None])
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string, spans int, th int, own string")).count() == 0


def test_constant_text_has_few_stretches():
    data = np.frombuffer(b"-" * 20_000, np.uint8)
    s = suffix_dedup.Stretches(data, np.array([0, len(data)]), 200)
    assert len(s.row) < 300
    covered = np.zeros(len(data), bool)
    for a, b in zip(s.own[1], s.own[2]):
        covered[a : b + 200] = True
    assert covered.all()


def test_every_way_to_cut():
    """Symbols of several words, of one and of one byte find the same windows."""
    rng = random.Random(5)
    used = set()
    for _ in range(60):
        letters = rng.choice(["abcd ", "abcdefghij  ", "ab", " bdfh \n"])
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        passage, bodies = text(230), []
        for _ in range(5):
            t = list(passage)
            if rng.random() < 0.4:
                t[rng.randrange(230)] = "z"
            bodies.append((text(rng.randrange(40)) + "".join(t) + text(rng.randrange(40))).encode())
        seen = {}
        for b in bodies:
            for j in range(len(b) - 199):
                seen[b[j : j + 200]] = seen.get(b[j : j + 200], 0) + 1
        want = [[seen[b[j : j + 200]] > 1 for j in range(len(b) - 199)] for b in bodies]
        for way in range(suffix_dedup.way_to_cut(bodies), len(suffix_dedup.CUTS)):
            cut, _, most = suffix_dedup.CUTS[way]
            if all(len(t) <= most for b in bodies for t in cut.findall(b)):
                used.add(way)
                assert [list(x) for x in suffix_dedup.repeats(bodies, 200, way)] == want
    assert used == {0, 1, 2}
