"""Sets of one band are listed by the signatures of its own family; pairs across bands still meet in the next one's."""

import random

import numpy as np

from weftlist.llm import jaccard_join


def components(spark, texts):
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 5), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}


def test_one_band_is_listed_once(spark, monkeypatch):
    rng, kept, keep = random.Random(4), {}, jaccard_join.keep
    monkeypatch.setattr(jaccard_join, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(120), 2):
            words[j] = f"x{i}y{j}"
        texts.append(" ".join(words))
    assert components(spark, texts) == dict.fromkeys(range(150), 0)
    own = 3 * (int(np.ceil(0.16 * jaccard_join.UPPER[np.searchsorted(jaccard_join.UPPER, 116)])) + 2)
    listed = kept["met"].selectExpr("explode(ids) as doc_id", "weight").groupBy("doc_id").sum("weight").collect()
    assert len(listed) == 150
    assert max(r[1] for r in listed) <= own


def test_pairs_across_bands(spark):
    """Each pair is exactly as similar as a link must be, and most lie in different bands."""
    texts = []
    for n in range(6, 240, 3):
        words = [f"n{n}w{i}" for i in range(n * 4 // 3 + 4)]
        texts += [" ".join(words[: n + 4]), " ".join(words)]
    got = components(spark, texts)
    assert got == {i: i - i % 2 for i in range(len(texts))}
