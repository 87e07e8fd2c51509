"""Type and entity counts from two tables of facts: names (id, relation, name) and types (entity_id, relation, type_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.functions import ling

# Beginnings of ids that have no names of interest.
SKIPPED = ("fb:user", "fb:base", "fb:freebase", "fb:common", "fb:type", "fb:measurement_unit")


def plural(word: Column) -> Column:
    """y becomes ies, s takes es, all else s."""
    return F.when(F.endswith(word, F.lit("y")), F.regexp_replace(word, "y$", "ies")).when(F.endswith(word, F.lit("s")), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def named(names: DataFrame) -> DataFrame:
    """(id, name) of quoted English names, those of skipped ids left out; of several names one stays."""
    skip = F.lit(False)
    for prefix in SKIPPED:
        skip = skip | F.startswith("id", F.lit(prefix))
    return names.where(~skip).select("id", F.expr("substring(name, 2, char_length(name) - 6)").alias("name")).groupBy("id").agg(F.max("name").alias("name"))


def pairs(names: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, type, entity) of every typed entity of which both have names. Type ids end with a full stop in the table."""
    own = named(names)
    facts = types.select("entity_id", F.expr("substring(type_id, 1, char_length(type_id) - 1)").alias("type_id"))
    out = facts.join(own.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id")
    return out.join(own.select(F.col("id").alias("type_id"), F.col("name").alias("type")), "type_id").select("type_id", "type", "entity")


def counts(typed: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, entity_repn, n) and (type_repn, entity_repn, n) of types of at most three words: as they are, and their last words' parts between slashes in the plural. Strings are represented by clusters (word, cluster)."""
    short = typed.where(F.size(F.split("type", " ")) <= 3)
    repn = lambda column: ling.cluster_shape(short.select(F.col(column).alias("s")).distinct(), ["s"], "s", clusters).select(F.col("s").alias(column), F.col("repn").alias(f"{column}_repn"))
    short = short.join(repn("entity"), "entity")
    first = short.groupBy("type", "entity_repn").agg(F.count("*").alias("n"))
    heads = short.select("entity_repn", F.explode(F.split(F.lower(F.element_at(F.split("type", " "), -1)), "/")).alias("part")).select("entity_repn", plural(F.col("part")).alias("head"))
    of = ling.cluster_shape(heads.select("head").distinct(), ["head"], "head", clusters).select("head", F.col("repn").alias("type_repn"))
    return first, heads.join(of, "head").groupBy("type_repn", "entity_repn").agg(F.count("*").alias("n"))
