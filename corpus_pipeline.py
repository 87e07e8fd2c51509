"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlist.llm import contamination, jaccard_join, line_chunks, packing, toxicity
from weftlist.llm.queries import HELD_OUT, tokenizer_path
from weftlist.llm.tables import keep, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; rows that repeat an id stand or fall together, rows of a null id stay."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(f"not ({HELD_OUT})"))
    bad = toxicity.score(docs, model).where("score >= 0.5").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of two lines or more go. A document that loses all its lines was made of copies, and goes too. n_chars follows the text."""
    out = line_chunks.dedup_passages(docs).where("n_removed < n_lines or n_lines = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr("if(n_removed = 0, n_chars, cast(char_length(text) as bigint))"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest id stays; of rows that repeat an id, all do."""
    gone = jaccard_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of any benchmark item go."""
    bad = contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), least_items=1).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of what is left in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL trains a model or packs; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
