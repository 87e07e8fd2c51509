"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A node holding s shards is split at the weighted quantile floor(s/2)/s of its bytes along its widest
dimension (range within the node against the range of all): size, language or source. Quantiles come from distributed
histograms of fixed size. The cut leaves a strip of about ``STRIP`` of the node's bytes undecided; its rows are dealt
by cells of a hash of the text, the heaviest that fit first, and one cell more by a hash of the id if the rest
is still large, so that copies of a text stay together unless a group is as large as to unbalance
the shards by itself. The driver sees at most shards * BINS sums a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlist.llm.tables import BROADCAST_IDS, keep

BINS = 1024
#: Dimensions of the tree: bytes of the text on a log scale, and places of the language and of the source among hashes.
DIMENSIONS = ("d_size", "d_lang", "d_source")
#: Share of a node's bytes around the cut that balances its two sides.
STRIP = 0.05
#: A cell of copies is cut only if more than this share of a shard is still missing.
TOLERANCE = 0.002
#: Rows of a shard that are numbered together at most, about.
SLOT_ROWS = 200_000


def _values(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    body = ", ".join("(" + ", ".join(f"cast({x!r} as {t})" for x, t in zip(row, types)) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(names)})")


def _sums(cells: DataFrame, column: str) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for r in cells.groupBy("node", F.col(column).alias("c")).agg(F.sum("size").alias("w")).collect():
        out.setdefault(r.node, {})[r.c] = float(r.w)
    return out


def _strip(weights: dict[int, float], goal: float) -> tuple[int, int, float]:
    """Cells around the one where the running sum reaches ``goal``, widened to ``STRIP`` of all, and how much of them goes to the left."""
    order = sorted(weights)
    run, at = 0.0, 0
    while at < len(order) - 1 and run + weights[order[at]] <= goal:
        run += weights[order[at]]
        at += 1
    lo = hi = at
    held = weights[order[at]]
    while held < STRIP * sum(weights.values()) and (lo > 0 or hi < len(order) - 1):
        if lo > 0:
            lo -= 1
            held += weights[order[lo]]
            run -= weights[order[lo]]
        if hi < len(order) - 1:
            hi += 1
            held += weights[order[hi]]
    return order[lo], order[hi], goal - run


def _fill(weights: dict[int, float], goal: float) -> tuple[list[int], float, dict[int, float]]:
    """Cells by descending weight as long as they fit, what is still missing, and the cells left."""
    taken, rest = [], {}
    for c, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if w <= goal:
            taken.append(c)
            goal -= w
        else:
            rest[c] = w
    return taken, goal, rest


def _split(rows: DataFrame, nodes: dict[int, tuple[int, int]], total: float, ranges) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """One level of the tree. nodes: id -> (shards, first shard)."""
    spark = rows.sparkSession
    bounds = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    plan = []
    for node, (shards, _) in nodes.items():
        if node not in bounds:
            plan.append((node, DIMENSIONS[0], 0.0, 1.0, 0.0, 1.0))
            continue
        r = bounds[node]
        wide = max(DIMENSIONS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / ((ranges[f"hi_{d}"] - ranges[f"lo_{d}"]) or 1.0), d))
        fraction = (shards // 2) / shards if shards > 1 else 1.0
        plan.append((node, wide, float(r[f"lo_{wide}"]), float((r[f"hi_{wide}"] - r[f"lo_{wide}"]) or 1.0), fraction * r.bytes, float(r.bytes)))
    table = _values(spark, [p[:4] for p in plan], ["node", "dim", "lo", "span"], ["int", "string", "double", "double"])
    x = F.when(F.col("dim") == DIMENSIONS[0], F.col(DIMENSIONS[0])).when(F.col("dim") == DIMENSIONS[1], F.col(DIMENSIONS[1])).otherwise(F.col(DIMENSIONS[2]))
    cells = rows.join(F.broadcast(table), "node").withColumn("c0", F.least(F.floor((x - F.col("lo")) / F.col("span") * BINS), F.lit(BINS - 1)).cast("int"))
    cells = cells.withColumn("c1", F.expr(f"pmod(th, {BINS})").cast("int")).withColumn("c2", F.expr(f"pmod(xxhash64(th, doc_id, n), {BINS})").cast("int"))
    goal = {p[0]: p[4] for p in plan}
    open_nodes = [n for n, (s, _) in nodes.items() if s > 1 and n in bounds]
    if not open_nodes:
        strips = {}
    else:
        sums = _sums(cells.where(F.col("node").isin(open_nodes)), "c0")
        strips = {n: _strip(sums[n], goal[n]) for n in open_nodes}  # (first cell, last cell, bytes that it has to give to the left)
    chosen = {n: [] for n in nodes}
    cut = {n: (-1, []) for n in nodes}
    if strips:
        within = " or ".join(f"(node = {n} and c0 between {lo} and {hi})" for n, (lo, hi, _) in strips.items())
        part = cells.where(within)
        missing = {}
        for n, weights in _sums(part, "c1").items():
            chosen[n], missing[n], rest = _fill(weights, strips[n][2])
            if missing[n] > TOLERANCE * total and rest:
                cut[n] = (min(rest, key=rest.get), [])
        again = [n for n, (c, _) in cut.items() if c >= 0]
        if again:
            for n, weights in _sums(part.where(" or ".join(f"(node = {n} and c1 = {cut[n][0]})" for n in again)), "c2").items():
                taken, left, rest = _fill(weights, missing[n])
                nearest = min(rest, key=rest.get, default=None)
                if nearest is not None and abs(left - rest[nearest]) < left:
                    taken.append(nearest)
                cut[n] = (cut[n][0], taken)
    decided = []
    for n, (s, _) in nodes.items():
        lo, hi, _ = strips.get(n, (0, -1, 0.0) if s > 1 else (BINS, BINS, 0.0))
        # A node of one shard keeps all its rows on the right.
        decided.append((n, 0 if s == 1 else lo, -1 if s == 1 else hi, chosen[n], cut[n][0], cut[n][1]))
    listed = lambda x: f"cast(array({', '.join(map(str, x))}) as array<int>)" if isinstance(x, list) else str(x)
    table = spark.sql("select * from values " + ", ".join(f"({', '.join(map(listed, row))})" for row in decided) + " as t(node, strip_lo, strip_hi, cells, cut, parts)")
    left = F.expr("c0 < strip_lo or c0 <= strip_hi and (array_contains(cells, c1) or c1 = cut and array_contains(parts, c2))")
    out = cells.join(F.broadcast(table), "node").withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1)).drop("dim", "lo", "span", "c0", "c1", "c2", "strip_lo", "strip_hi", "cells", "cut", "parts")
    after = {}
    for node, (shards, first) in nodes.items():
        if shards > 1:
            after[node * 2], after[node * 2 + 1] = (shards // 2, first), (shards - shards // 2, first + shards // 2)
        else:
            after[node * 2 + 1] = (1, first)
    return out, after


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``.

    Size is the text's UTF-8 bytes and 8 (a null text has none). Shards hold nearly the same bytes, within the
    largest row and ``TOLERANCE`` for each level. Equal texts go to one shard unless their group straddles a boundary and is large.
    Slots number a shard's rows from 0 without gaps. Null ids, languages, sources and texts and repeated rows are rows like others;
    missing columns of language or source are as if empty, other columns are ignored.
    """
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string") if c in docs.columns else F.lit(""), F.lit(""))), F.lit(1000)).cast("double")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
        place(lang_col).alias("d_lang"), place(source_col).alias("d_source"),
    )
    # Repeated rows get numbers by which they can be dealt to different shards.
    rows = rows.withColumn("d_size", F.log2("size")).withColumn("n", F.monotonically_increasing_id())
    rows = keep(rows.withColumn("node", F.lit(1)), "rows")
    # Copies take part by the least of their places, so that they aren't told apart.
    least = rows.groupBy("th").agg(F.count("*").alias("copies"), *[F.min(d).alias(f"least_{d}") for d in DIMENSIONS[1:]]).where("copies > 1").drop("copies")
    least = keep(least, "copies")
    if least.count() <= BROADCAST_IDS // 8:
        least = F.broadcast(least)
    rows = rows.join(least, "th", "left").withColumns({d: F.coalesce(f"least_{d}", d) for d in DIMENSIONS[1:]}).drop(*[f"least_{d}" for d in DIMENSIONS[1:]])
    rows = keep(rows, "rows")
    ranges = rows.agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    nodes = {1: (shards, 0)}
    while ranges.bytes and max(s for s, _ in nodes.values()) > 1:
        rows, nodes = _split(rows, nodes, ranges.bytes / shards, ranges)
        rows = keep(rows, "rows")
    number = _values(spark, [(node, first) for node, (_, first) in nodes.items()], ["node", "shard"], ["int", "int"])
    rows = rows.join(F.broadcast(number), "node")
    blocks = max(1, rows.count() // (shards * SLOT_ROWS))
    rows = rows.withColumn("block", F.expr(f"pmod(xxhash64(n), {blocks})"))
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    sizes = sizes.select("shard", "block", (F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "n")) - 1
    out = rows.withColumn("place", slot).join(F.broadcast(sizes), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
