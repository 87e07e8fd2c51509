"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlist.llm import contamination, jaccard_join, kd_shards, license_scan, line_chunks, order_minhash, packing, suffix_dedup, toxicity, url_rules
from weftlist.llm.tables import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(f"not ({HELD_OUT})"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(read(spark, sf_dir, "documents"), 24)


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, url_rules.RULES)) + " as t(host, path, verdict)")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules)


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_toxicity, op3_order_minhash, op4_license_scan, op5_kd_shards, op6_contamination, op7_suffix_dedup, op8_packing, op9_url_rules, op10_line_chunks)}


def _last_rule() -> str:
    """The longest rule that fits, as nested tests in SQL."""
    cases = []
    for host, path, _ in sorted(url_rules.RULES, key=lambda r: -len(r[0] + r[1])):
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'")
    return "CASE " + " ".join(cases) + " END"


def oracle_sql() -> dict[str, str]:
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in url_rules.RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op9_url_rules": f"""
            WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
            t AS (SELECT *, {_last_rule()} AS rule FROM s)
            SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, 'allow') AS verdict FROM t""",
        "op10_line_chunks": line_chunks.ORACLE,
    }
