"""Empty tables, nulls in every column, repeated rows and very long texts through each operator."""

import pytest

from weftlist.llm import contamination, jaccard_join, kd_shards, license_scan, line_chunks, order_minhash, packing, suffix_dedup, toxicity, url_rules
from weftlist.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, "short"), (1, "short"), (1, "other"), (None, "short"), (None, None), (2, None), (3, ""), (4, LONG), (5, LONG), (6, "\n\n"), (7, "日本語" * 50)]


def operators(spark):
    items = spark.createDataFrame([(1, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8"), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rules = spark.createDataFrame([("org", "/", "allow"), (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    return {
        "jaccard": lambda d: jaccard_join.jaccard_components(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "fingerprints": lambda d: order_minhash.compare(d),
        "license": lambda d: license_scan.scan(d),
        "shards": lambda d: kd_shards.shard(d, 5),
        "contamination": lambda d: contamination.decontaminate(d, items),
        "no benchmark": lambda d: contamination.decontaminate(d, items.where("false")),
        "suffixes": lambda d: suffix_dedup.remove_repeats(d),
        "lines": lambda d: line_chunks.dedup_lines(d),
        "passages": lambda d: line_chunks.dedup_passages(d),
        "urls": lambda d: url_rules.judge(d, rules, id_col="doc_id", url_col="text"),
        "no rules": lambda d: url_rules.judge(d, rules.where("false"), id_col="doc_id", url_col="text"),
    }


NAMES = ["jaccard", "toxicity", "fingerprints", "license", "shards", "contamination", "no benchmark", "suffixes", "lines", "passages", "urls", "no rules"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay_rows(spark, name):
    """One row for each row, equal rows alike, whatever is null, repeated, long or empty; and none for none."""
    schema = "doc_id long, text string, node string, th long, spans string, low int, k1 long, rep long"
    docs = spark.createDataFrame([(i, t, "n", 1, "s", 2, 3, 4) for i, t in ROWS], schema).repartition(3)
    run = operators(spark)[name]
    got = run(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert run(docs.where("false")).count() == 0


def test_packing_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert sorted(r.length for r in got if r.doc_id in (2, 3)) == [1, 1]
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0
