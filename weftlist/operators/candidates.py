"""Candidate lists: generalised paths as masks over node positions, executed by one join and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlist.functions import text

# Tags whose nodes never seed a path.
NO_SEED = ("html", "head", "body", "script", "noscript", "link", "style")
PAGE = ["page_id", "root_no"]


def with_texts(lists: DataFrame, nodes: DataFrame, ids: str = "node_ids", into: str = "entities") -> DataFrame:
    """``lists`` with the texts of their nodes. A page's nodes are numbered without gaps, so its texts are one array."""
    texts = nodes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pre_id", "full_text"))).alias("_texts"))
    return lists.join(texts, PAGE).withColumn(into, F.transform(ids, lambda i: F.get("_texts", i)["full_text"])).drop("_texts")


def candidates(nodes: DataFrame, depth: int = 8, least: int = 3) -> DataFrame:
    """(page_id, root_no, xpath, node_ids, entities): every path with at least ``least`` nodes.

    A seed's path keeps the index of levels where its tag repeats; each subset of the last ``depth`` such levels may drop
    its own. A path is the tags and kept indices; it selects all non-empty nodes of the same tags whose indices agree.
    """
    live = nodes.where("full_text is not null and full_text <> ''").select(*PAGE, "pre_id", "idxs", F.array_join("tags", "/").alias("sig"), (~F.col("tag").isin(*NO_SEED)).alias("seed"), F.expr("filter(sequence(1, size(tags)), l -> l < size(tags) and sibs[l] > 1)").alias("keep"), F.expr(f"size(tags) - {depth}").alias("low"))
    # Shapes first: masks are enumerated once for all seeds of a page with the same tags and repeated levels.
    shapes = live.where("seed").select(*PAGE, "sig", "keep", "low").distinct()
    shapes = shapes.withColumns({"fixed": F.expr("filter(keep, l -> l < low)"), "free": F.expr("filter(keep, l -> l >= low)")})
    masks = shapes.withColumn("m", F.explode(F.expr("sequence(0, cast(shiftleft(1, size(free)) as int) - 1)"))).select(*PAGE, "sig", F.expr("concat(fixed, filter(free, (l, i) -> (shiftright(m, i) & 1) = 1))").alias("mask")).distinct()
    # A node is a seed of a mask if the mask keeps none but its repeated levels, and all of those too far up.
    own = F.expr("seed and forall(mask, l -> array_contains(keep, l)) and forall(filter(keep, l -> l < low), l -> array_contains(mask, l))")
    hits = live.join(masks, [*PAGE, "sig"]).select(*PAGE, "sig", "mask", F.expr("transform(mask, l -> idxs[l])").alias("key"), "pre_id", own.alias("own"))
    found = hits.groupBy(*PAGE, "sig", "mask", "key").agg(F.array_sort(F.collect_list("pre_id")).alias("node_ids"), F.bool_or("own").alias("own")).where(f"own and size(node_ids) >= {least}")
    xpath = F.expr("concat('/', array_join(transform(split(sig, '/'), (t, l) -> if(l = 0, concat(t, '[', root_no + 1, ']'), if(array_contains(mask, l), concat(t, '[', key[cast(array_position(mask, l) - 1 as int)] + 1, ']'), t))), '/'))")
    return with_texts(found.select(*PAGE, xpath.alias("xpath"), "node_ids"), nodes).select(*PAGE, "xpath", "node_ids", "entities")


def normalized(df: DataFrame, keys: list[str], column: str, level: int) -> DataFrame:
    """``df`` with the strings of an array column normalised, each different string once."""
    if level < 2:
        return df.withColumn(column, F.transform(column, lambda e: text.normalize(e, level)))
    each = df.select(*keys, F.posexplode(column).alias("_i", "_e"))
    forms = each.select("_e").distinct().withColumn("_n", text.normalize(F.col("_e"), level))
    lists = each.join(forms, "_e").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_n"))), lambda x: x["_n"]).alias("_list"))
    return df.join(lists, keys, "left").withColumn(column, F.coalesce("_list", F.slice(column, 1, 0))).drop("_list")


def groups(cands: DataFrame, level: int = 0) -> DataFrame:
    """Candidates with equal node lists as one group (page_id, root_no, group_id, node_ids, entities, xpaths), its strings normalised at ``level``; strings may become empty or equal and all stay."""
    out = cands.groupBy(*PAGE, "node_ids").agg(F.first("entities").alias("entities"), F.array_sort(F.collect_list("xpath")).alias("xpaths")).withColumn("group_id", F.xxhash64("node_ids"))
    return normalized(out, [*PAGE, "group_id"], "entities", level) if level else out


def one_per_group(cands: DataFrame) -> DataFrame:
    """Of the candidates with equal node lists the first by path."""
    w = Window.partitionBy(*PAGE, F.xxhash64("node_ids"), "node_ids").orderBy("xpath")
    return cands.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cut_ranges(groups: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, root_no, group_id, cut_start, cut_end, node_ids): lists without their first node, given once for each of up to five cuts at the start, and without their last 1 to 9, as long as more than ``least`` nodes stay."""
    n = F.size("node_ids")
    front = F.transform(F.expr(f"if(size(node_ids) > {least}, sequence(0, least(5, size(node_ids) - {least}) - 1), array())"), lambda i: F.struct(i.cast("int").alias("cut_start"), F.lit(0).alias("cut_end")))
    back = F.transform(F.expr(f"if(size(node_ids) > {least + 1}, sequence(1, least(10, size(node_ids) - {least}) - 1), array())"), lambda i: F.struct(F.lit(0).alias("cut_start"), i.cast("int").alias("cut_end")))
    rows = groups.select(*PAGE, "group_id", "node_ids", F.explode(F.concat(front, back)).alias("c"))
    kept = F.when(F.col("c.cut_end") == 0, F.slice("node_ids", F.lit(2), n - 1)).otherwise(F.slice("node_ids", F.lit(1), n - F.col("c.cut_end")))
    return rows.select(*PAGE, "group_id", "c.cut_start", "c.cut_end", kept.alias("node_ids"))
