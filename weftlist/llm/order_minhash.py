"""Order MinHash fingerprints, in DataFrame operations only.

Tokens are words, or, in runs of over ``TOKEN`` code points without a blank, all overlapping stretches of ``INNER`` code points, so
that an insertion only touches what is beside it; k-mers are ``K`` consecutive tokens, each numbered by its
occurrence, so repeats count. One hash of (k-mer, number) deals them to ``SKETCHES`` groups and orders them within
a group; the ``KEEP`` smallest of a group are put back in text order and hashed as a tuple. Two texts share
a group's hash if they share these k-mers in the same order, which is sensitive to edit distance where
plain MinHash sees only content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlist.llm.tables import boxed, fence, keep, parts, unboxed

K, TOKEN, INNER, SKETCHES, KEEP = 2, 24, 5, 32, 2
_PLACE = 28  # bits of a token's place


def sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of SKETCHES hex strings, '' for a group without k-mers.

    Texts of fewer tokens than a k-mer are one k-mer; null, empty and blank texts have none, so all groups are ''. Equal texts have equal sketches.
    """
    mask, bins = (1 << _PLACE) - 1, SKETCHES
    runs = "regexp_extract_all(_x, '\\\\S+', 0)"
    inner = f"transform({runs}, w -> if(char_length(w) <= {TOKEN}, array(w), regexp_extract_all(w, '(?=(\\\\S{{{INNER}}}))', 1)))"
    df = fence(df, "_x", f"coalesce({text}, '')")
    df = fence(df, "_t", f"if(_x rlike '\\\\S{{{TOKEN + 1}}}', flatten({inner}), {runs})")
    grams = ", ".join(f"coalesce(get(_t, i + {j}), '')" for j in range(K))
    df = fence(df, "_g", f"if(size(_t) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size(_t) - {K})), i -> xxhash64({grams})))")
    # Sorted by k-mer and place, equal k-mers stand side by side: their rank in the run is the occurrence number.
    df = fence(df, "_s", f"array_sort(transform(_g, (h, i) -> (h & {~mask}L) | i))")
    df = fence(df, "_b", f"filter(transform(_s, (x, i) -> if(i = 0 or shiftright(x, {_PLACE}) <> shiftright(_s[i - 1], {_PLACE}), i, -1)), i -> i >= 0)")
    df = fence(df, "_n", "flatten(transform(_b, (s, j) -> sequence(0, coalesce(get(_b, j + 1), size(_s)) - s - 1)))")
    # bin | hash | place, all in one number that sorts in that order
    df = fence(df, "_o", f"array_sort(transform(_s, (x, i) -> (pmod(xxhash64(shiftright(x, {_PLACE}), _n[i]), {bins}) << 58) | ((xxhash64(_n[i], shiftright(x, {_PLACE})) & {(1 << 30) - 1}L) << {_PLACE}) | (x & {mask}L)))")
    df = fence(df, "_e", f"map_from_entries(filter(transform(_o, (x, i) -> if(i = 0 or shiftright(x, 58) <> shiftright(_o[i - 1], 58), struct(cast(shiftrightunsigned(x, 58) as int), i + 1), null)), p -> p is not null))")
    df = fence(df, name, f"""transform(sequence(0, {bins - 1}), b -> if(element_at(_e, b) is null, '',
        hex(aggregate(array_sort(transform(filter(slice(_o, element_at(_e, b), {KEEP}), x -> shiftrightunsigned(x, 58) = b), x -> x & {mask}L)), 0L, (acc, i) -> xxhash64(acc, _g[cast(i as int)])))))""")
    return df.drop("_x", "_t", "_g", "_s", "_b", "_n", "_o", "_e")


def likeness(a: str, b: str):
    """The share of groups, of those that either text fills, on which both agree; 1 if neither fills any."""
    return F.expr(f"""if(size(filter({a}, x -> x <> '')) = 0 and size(filter({b}, x -> x <> '')) = 0, 1.0D,
        size(filter(zip_with({a}, {b}, (x, y) -> x = y and x <> ''), x -> x)) / cast(size(filter(zip_with({a}, {b}, (x, y) -> x <> '' or y <> ''), x -> x)) as double))""")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with column ``fingerprint``, that of null and empty texts having only empty parts; other columns pass through whatever their names."""
    out = sketch(boxed(docs, text=text_col), "text", "f")
    return unboxed(out.withColumn("fingerprint", F.array_join("f", "-")), docs, "fingerprint")


def with_next(docs: DataFrame, columns: list[str], buckets: int, ids: DataFrame) -> DataFrame:
    """Each row with ``next_<column>`` of the next row in descending order of doc_id; after the last comes the first.

    Ids are range-partitioned; the first row of each bucket is also sent to the bucket before it, so that no task
    holds more than a bucket. Equal ids follow each other in order of text; null ids come last. ``ids`` holds the
    column doc_id of the same rows, from a plan that leaves out what ``docs`` computes.
    """
    ids = keep(ids.select("doc_id").repartitionByRange(buckets, F.col("doc_id").desc_nulls_last()).withColumn("bucket", F.spark_partition_id()), "ids")
    edges = ids.groupBy("bucket").agg(F.max("doc_id").alias("high"), F.min("doc_id").alias("low"), F.count("*").alias("rows"), F.count("doc_id").alias("named")).orderBy("bucket").collect()
    tops = [r.high for r in edges if r.named]
    if not tops:
        tops = [0]
    # Bucket of an id: the last whose highest id is at least the id; equal ids stay together.
    array = "array(" + ", ".join(f"{t}L" for t in tops) + ")"
    n = len(tops)
    rows = docs.withColumn("_bucket", F.expr(f"coalesce(size(filter({array}, t -> t >= doc_id)) - 1, {n - 1})"))
    rows = rows.withColumn("_copy", F.expr(f"if(doc_id in ({', '.join(f'{t}L' for t in tops)}), array(false, true), array(false))")).withColumn("_guest", F.explode("_copy")).drop("_copy")
    rows = rows.withColumn("_bucket", F.expr(f"if(_guest, pmod(_bucket - 1, {n}), _bucket)")).repartition(buckets, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").desc_nulls_last(), *columns[:1])
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("not _guest").drop("_bucket", "_guest")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, with their likeness.

    The edited text is the text with its last third of code points (rounded down) replaced by as many first ones of the
    next document in descending doc_id, or all it has. A lone document is its own next. Null texts are empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = max(1, parts(docs.sparkSession))
    rows = with_next(sketch(docs, "text", "f"), ["text", "f"], buckets, docs)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = fence(rows, "edited", "concat(left(text, cast(n_chars as int) - cut), left(next_text, cut))")
    rows = sketch(rows.drop("next_text", "text"), "edited", "g")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("f", "-").alias("fingerprint"), F.array_join("g", "-").alias("edited_fingerprint"), likeness("f", "g").alias("near_edited"), likeness("f", "next_f").alias("near_next"))
