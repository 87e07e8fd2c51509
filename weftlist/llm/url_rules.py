"""URL rules by a sort-merge range join.

A rule (host, path) becomes an interval of canonical keys: the host's labels reversed, then the path;
every key with the rule's prefix lies in it. A url has a key for its host and for each parent domain, so a rule
fits exactly if one of these keys lies in its interval. Rule intervals nest; a sorted sweep over
their ends keeps the stack of active rules as a depth, and the top of the stack after each end is
the last rule opened at that depth. That leaves disjoint segments, each with its innermost rule, which
are merged with the sorted keys; among a url's keys the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlist.llm.tables import keep, parts

#: Rows (host, path, verdict) of the registered query; host and all its subdomains, paths that start so.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_path(url: str):
    """(host, path) columns of a url column: host between the first :// and the next / ? # or the end, A-Z lower-cased; path from there to ? # or the end."""
    rest = f"if(locate('://', {url}) > 0, substring({url}, locate('://', {url}) + 3), '')"
    host = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.expr(f"coalesce(translate({host}, '{upper}', '{lower}'), '')"), F.expr(f"coalesce({path}, '')")


def _key(labels: str, path: str):
    """Reversed labels end with \\x01 each, the path starts after \\x02: no label or path sorts into another's interval. In labels these marks are written as \\x03 and a letter."""
    plain = "replace(replace(replace(x, '\\u0003', '\\u0003c'), '\\u0001', '\\u0003a'), '\\u0002', '\\u0003b')"
    return F.expr(f"concat(array_join(transform(reverse({labels}), x -> {plain}), '\\u0001'), '\\u0001\\u0002', {path})")


def segments(rules: DataFrame) -> DataFrame:
    """(key, rule): from ``key`` on, up to the next one, ``rule`` is the innermost (null: none). Native windows over the rules alone."""
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("low", _key("split(host, '[.]')", "path"))
    # The end is the prefix with its last code point raised by one.
    rules = rules.withColumn("high", F.expr("concat(substring(low, 1, char_length(low) - 1), decode(unhex(lpad(hex(conv(hex(encode(right(low, 1), 'UTF-32')), 16, 10) + 1), 8, '0')), 'UTF-32'))"))
    rule = F.struct("host", "path", "verdict")
    events = rules.select(F.col("low").alias("key"), F.lit(1).alias("step"), rule.alias("rule"), F.length("low").alias("size")).unionAll(rules.select("high", F.lit(-1), rule, F.length("low")))
    # Ends come before starts at a key; of several ends the longest rule first, of several starts the shortest.
    order = [F.col("key"), F.col("step"), F.col("size") * F.col("step")]
    top = Window.partitionBy(F.lit(0)).orderBy(*order)
    events = events.withColumn("depth", F.sum("step").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("active", F.when(F.col("depth") > 0, F.last(F.when(F.col("step") == 1, F.col("rule")), True).over(level)))
    last = F.max_by(F.struct("active"), F.struct("depth_order")).alias("rule")
    events = events.withColumn("depth_order", F.row_number().over(top))
    return events.groupBy("key").agg(last).select("key", F.col("rule.active").alias("rule"))


def sweep(points: DataFrame, segs: DataFrame, buckets: int) -> DataFrame:
    """``points`` with column ``rule``: that of the last segment at or before ``key``.

    Segments and points are merged in one sort by range buckets; a bucket starts with the
    segment that the buckets before it left open, which one row for each bucket tells.
    """
    names = [c for c in points.columns if c != "key"]
    empty = F.lit(None)
    both = points.withColumn("kind", F.lit(1)).withColumn("rule", F.lit(None).cast(segs.schema["rule"].dataType)).unionByName(segs.select("key", "rule", F.lit(0).alias("kind"), *[empty.cast(points.schema[c].dataType).alias(c) for c in names]))
    # Salting by the row spreads a key that very many points share.
    both = keep(both.withColumn("salt", F.when(F.col("kind") == 1, F.xxhash64(*names)).otherwise(F.lit(-(2**63)))).repartitionByRange(buckets, "key", "kind", "salt").withColumn("bucket", F.spark_partition_id()), "swept")
    ends = both.where("kind = 0").groupBy("bucket").agg(F.max_by(F.struct("rule"), "key").alias("open"))
    all_buckets = both.select("bucket").distinct().join(ends, "bucket", "left")
    carry = all_buckets.select("bucket", F.last("open", True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.last(F.when(F.col("kind") == 0, F.struct("rule")), True).over(Window.partitionBy("bucket").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("inside", inside).where("kind = 1").join(F.broadcast(carry), "bucket").select(*names, F.coalesce("inside", "before").getField("rule").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; of several the one with most
    characters wins, of equals the longer host, of the same rule given twice block. No rule: null and
    ``otherwise``. A null url, or one without ://, has empty host and path. Repeated rows, and rows of a null
    id, each give a row. An empty rule table leaves all to ``otherwise``.
    """
    buckets = max(1, parts(pages.sparkSession))
    host, path = host_path("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    distinct = rows.groupBy("host", "path").agg(F.count("*").alias("copies")).drop("copies")
    labels = distinct.withColumn("labels", F.expr("split(host, '[.]')"))
    keys = labels.select("host", "path", F.explode(F.expr("transform(sequence(1, size(labels)), i -> slice(labels, i, size(labels)))")).alias("own"))
    points = keys.select("host", "path", _key("own", "path").alias("key"))
    hit = sweep(points, segments(rules), buckets).where("rule is not null")
    best = hit.groupBy("host", "path").agg(F.max_by("rule", F.struct(F.expr("char_length(rule.host) + char_length(rule.path)"), F.expr("char_length(rule.host)"))).alias("rule"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(otherwise)).alias("verdict"))
