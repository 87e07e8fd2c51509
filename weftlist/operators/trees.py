"""Navigation in the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.operators.candidates import PAGE


def children(nodes: DataFrame, tag: str = "*", index: int | None = None) -> DataFrame:
    """Children by tag, * for any, and by place among those; parents without such a child have no row."""
    out = nodes.where(F.col("parent_id").isNotNull())
    out = out if tag == "*" else out.where(F.col("tag") == tag)
    return out if index is None else out.where(F.col("child_idx" if tag == "*" else "child_idx_tag") == index)


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value, empty where it is missing."""
    return F.coalesce(attrs[name], F.lit(""))


def attribute_list(attrs: Column, name: str) -> Column:
    """An attribute's parts between single blanks, none where it is missing or empty."""
    return F.when(attribute(attrs, name) == "", F.array().cast("array<string>")).otherwise(F.split(attribute(attrs, name), " "))


def common_ancestor(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(page_id, root_no, group_id, pre_id): the lowest node that is or contains all nodes of a group."""
    own = groups.select(*PAGE, "group_id", F.explode("node_ids").alias("pre_id")).join(nodes.select(*PAGE, "pre_id", F.concat("ancestors", F.array("pre_id")).alias("line")), [*PAGE, "pre_id"])
    # A common ancestor is on as many lines as there are nodes, and the lowest has the largest number.
    n = groups.select(*PAGE, "group_id", F.size(F.array_distinct("node_ids")).alias("n"))
    on = own.select(*PAGE, "group_id", "pre_id", F.explode("line").alias("a")).distinct().groupBy(*PAGE, "group_id", "a").agg(F.count("*").alias("lines"))
    return on.join(n, [*PAGE, "group_id"]).where("lines = n").groupBy(*PAGE, "group_id").agg(F.max("a").alias("pre_id"))


def is_descendant(node_ancestors: Column, node: Column, of: Column) -> Column:
    """Whether a node is another or lies below it."""
    return (node == of) | F.array_contains(node_ancestors, of)


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Copies of the subtrees at ``roots`` (page_id, root_no, top), numbered and placed from their own top."""
    at = nodes.join(roots, PAGE).where(is_descendant(F.col("ancestors"), F.col("pre_id"), F.col("top")))
    level = F.col("depth") - F.element_at("tags", 1).isNotNull().cast("int") * 0
    up = F.array_position(F.concat("ancestors", F.array("pre_id")), F.col("top")).cast("int")
    out = at.withColumn("copy_id", F.col("pre_id") - F.col("top")).withColumn("copy_parent", F.when(F.col("pre_id") != F.col("top"), F.col("parent_id") - F.col("top")))
    return out.withColumn("copy_depth", F.size("ancestors") - up + 1).select(*PAGE, "top", "copy_id", "copy_parent", "copy_depth", "tag", "full_text", "attrs")


def outline(nodes: DataFrame) -> DataFrame:
    """(page_id, root_no, pre_id, line): a line for each node, indented by two blanks a level; too long a text is three dots."""
    text = F.when(F.col("tag") == "text", F.coalesce("full_text", F.lit("..."))).otherwise(F.concat(F.lit("<"), "tag", F.lit(">")))
    return nodes.select(*PAGE, "pre_id", F.concat(F.repeat(F.lit(" "), (F.col("depth") - 2) * 2), text).alias("line"))
