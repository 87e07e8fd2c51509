"""The pipeline's line dedup goes by content-defined chunks first and extends them to whole runs."""

import hashlib
import random

from weftlist.llm import line_chunks
from test_lines_whole import brute


def chunks(text):
    """(first line, last line, lines) of each chunk, by the rule that the SQL of op10 states."""
    lines, out, start = text.split("\n"), [], 0
    md5 = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    for i in range(len(lines)):
        if i == len(lines) - 1 or hashlib.md5(((md5[i - 1] if i else "") + md5[i]).encode()).hexdigest()[0] < "4":
            out.append((start, i, tuple(lines[start : i + 1])))
            start = i + 1
    return out


def test_pipeline_takes_chunks(spark, monkeypatch):
    import corpus_pipeline

    rng, kept = random.Random(4), {}
    passages = [[f"passage {p} line {i}" for i in range(2 + 3 * p)] for p in range(6)]
    texts = ["\n".join([f"own {i}", *rng.choice(passages), f"mid {i}", *rng.choice(passages), "x", "x", "x"]) for i in range(40)]
    write = line_chunks.keep
    monkeypatch.setattr(line_chunks, "keep", lambda df, name: kept.update({name: write(df, name)}) or kept[name])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = brute(list(enumerate(texts)))
    assert got == {i: want[i, t][0] for i, t in enumerate(texts) if want[i, t][2] < want[i, t][1]}

    first, copied = {}, set()
    for i, t in enumerate(texts):
        for low, high, lines in chunks(t):
            if high > low and first.setdefault(lines, (i, low)) != (i, low):
                copied.add((i, low, high))
    assert len(copied) > 20
    assert {(r.doc_id, r.place, r.last) for r in kept["copied"].collect()} == copied
    inside = {(i, p) for i, low, high in copied for p in range(low, high)}
    assert not inside & {(r.doc_id, r.place) for r in kept["again_windows"].collect()}
