"""Buckets of signatures follow the number of shingles, whatever the table's files or plan say."""

import random

import pytest

from weftlist.llm import jaccard_join


@pytest.mark.parametrize("stored", [True, False])
def test_buckets_follow_shingles(spark, monkeypatch, tmp_path, stored):
    rng, asked, emit = random.Random(2), [], jaccard_join._emit
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 500, raising=False)
    monkeypatch.setattr(jaccard_join, "_emit", lambda width, buckets, common: asked.append(buckets) or emit(width, buckets, common))
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(300)) for _ in range(40)]
    texts += [t + " z" for t in texts[:10]] + texts[:5]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 3), "doc_id long, text string")
    if stored:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i if i < 40 else i - 40 if i < 50 else i - 50 for i in range(55)}
    assert 20 <= asked[0] <= 40
