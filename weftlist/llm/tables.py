"""Shared-folder tables, lineage cuts and size-checked joins used by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids is broadcast only when it has been counted and holds at most this many rows (8 bytes each).
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in local mode, where it may be unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="weftlist-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def only_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the one-column ``ids``.

    The list is counted first: small ones are broadcast, so that long rows stay where they are;
    larger ones go through an ordinary shuffled semi-join.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def fence(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column computed once for each row.

    A generator over a single element stands between the projections: merged into one, an array that a
    lambda looks into would be computed again for each of its elements.
    """
    value = F.expr(value) if isinstance(value, str) else value
    return df.select("*", F.explode(F.array(value)).alias(name))


def boxed(docs: DataFrame, **names: str) -> DataFrame:
    """``docs`` with columns by the given names and all columns under names of their own (box0, box1, ..), which working names can't clash with."""
    columns = [F.col(f"`{c}`").alias(f"box{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], *columns)


def unboxed(df: DataFrame, docs: DataFrame, *more: str, **changed: str) -> DataFrame:
    """The columns of ``docs`` by their names again, those in ``changed`` (column name to working name) replaced, and ``more``; of equal names the new ones stay."""
    kept = [F.col(changed.get(c, f"box{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in more]
    return df.select(*kept, *more)
