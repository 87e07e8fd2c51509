"""Repeated passages of lines against brute force."""

import random

from weftlist.llm import line_chunks


def brute(texts, k=2):
    """Texts by (id, text) without lines that an earlier equal run of ``k`` lines or more covers."""
    lines = {key: key[1].split("\n") for key in sorted({(i, t) for i, t in texts if i is not None and t is not None})}
    at = {}
    for key, own in lines.items():
        for p in range(len(own) - k + 1):
            at.setdefault(tuple(own[p : p + k]), []).append((key[0], p, key))
    out = {}
    for key, own in lines.items():
        gone = set()
        for p in range(len(own) - k + 1):
            i, q, other = min(at[tuple(own[p : p + k])])
            if (i, q, other) != (key[0], p, key):
                gone |= set(range(max(p, q + k) if other == key else p, p + k))
        out[key] = ("\n".join(x for j, x in enumerate(own) if j not in gone), len(own), len(gone))
    return out


def test_passages_shift_and_extend(spark):
    rng = random.Random(8)
    passages = [[f"passage {p} line {i} {rng.random()}" for i in range(2 + p % 7)] for p in range(12)]
    texts = []
    for i in range(60):
        own = [f"own {i} {j}" for j in range(rng.randrange(6))]
        at = rng.randrange(len(own) + 1)
        a, b = rng.sample(passages, 2)
        texts.append((i, "\n".join(own[:at] + a + own[at:] + b)))
    texts += [(100, "a\na\na\na"), (101, "\n\n"), (102, "b\na\na"), (103, "one"), (104, None), (105, ""), (None, texts[0][1]), texts[0], (106, "one"), (107, "\n".join(passages[5]))]
    docs = spark.createDataFrame([(i, t, j) for j, (i, t) in enumerate(texts)], "doc_id long, text string, n long").repartition(3)
    for k in (1, 2):
        want = brute(texts, k)
        got = line_chunks.dedup_passages(docs, k).collect()
        assert len(got) == len(texts)
        for r in got:
            i, t = texts[r.n]
            expect = (t, 0 if t is None else len(t.split("\n")), 0) if i is None or t is None else want[i, t]
            assert (r.text, r.n_lines, r.n_removed) == expect
    left = "\n".join(r.text or "" for r in line_chunks.dedup_passages(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect())
    assert all(left.count("\n".join(p)) == 1 and left.count(p[0]) == 1 for p in passages)


def test_pipeline_removes_short_passages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"own {i}\nalpha beta\ngamma delta\nend {i}", 0) for i in range(20)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert rows == {i: f"own {i}\nend {i}" if i else "own 0\nalpha beta\ngamma delta\nend 0" for i in range(20)}
