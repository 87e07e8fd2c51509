"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-grams the one with the smallest hash is kept, on both sides, so a shared
span of k + w - 1 words always shares a kept k-gram at the same place. Test fingerprints are a sorted
array; training fingerprints are looked up in it, and each hit is extended word by word to the whole
shared run. Items shorter than a window are looked up with their whole length as k and w = 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.tables import keep
from weftlist.llm.words import ALNUM, SLICE_BYTES, U, Words, grams, lean, text_slices

#: Benchmark text bytes that one pass over the documents takes; a larger benchmark goes in several.
BLOCK_BYTES = 8 << 20


def winnow(value: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Positions of the k-grams that are smallest in some ``w`` consecutive ones of their row (the last of equals)."""
    n = len(value)
    if w == 1 or not n:
        return np.arange(n)
    if n < w:
        return np.arange(n)
    best = np.arange(n - w + 1)
    for j in range(1, w):
        better = value[j : n - w + 1 + j] <= value[best]
        best = np.where(better, np.arange(j, n - w + 1 + j), best)
    kept = np.zeros(n, bool)
    kept[best[row[: n - w + 1] == row[w - 1 :]]] = True
    count = np.bincount(row, minlength=int(row[-1]) + 1) if n else np.zeros(0)
    kept |= count[row] < w
    return np.flatnonzero(kept)


class Index:
    """The fingerprints of some benchmark texts."""

    def __init__(self, texts: list[str], window: int, k: int):
        self.window, self.k = window, k
        words = [Words(data, offs, ALNUM) for _, _, data, offs in text_slices(pa.array(texts, pa.large_string()))]
        self.hash = np.concatenate([x.hash for x in words]) if words else np.zeros(0, U)
        self.count = np.concatenate([x.count for x in words]) if words else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.item = np.repeat(np.arange(len(self.count)), self.count)
        self.tables = {}
        for length in sorted({min(int(c), window) for c in self.count if c}):
            gram = k if length == window else length
            chosen = self.count >= window if length == window else self.count == length
            use = np.flatnonzero(chosen[self.item])
            view = _View(self.hash[use], self.item[use])
            value, row, at = grams(view, gram)
            at = at[kept := winnow(value, row, window - k + 1 if length == window else 1)]
            order = np.argsort(value[kept], kind="stable")
            self.tables[length] = gram, value[kept][order], use[at][order]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, item) of the shared runs of at least a window."""
        found = []
        for length, (gram, prints, place) in self.tables.items():
            value, row, at = grams(words, gram)
            kept = winnow(value, row, self.window - self.k + 1 if length == self.window else 1)
            value, at = value[kept], at[kept]
            low, high = np.searchsorted(prints, value, "left"), np.searchsorted(prints, value, "right")
            n = high - low
            p = np.repeat(at, n)
            q = place[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            if length < self.window:
                found.append((p, p + gram, self.item[q]))
                continue
            doc_low, doc_high = words.first[words.row[p]], words.first[words.row[p]] + words.count[words.row[p]]
            item_low, item_high = self.first[self.item[q]], self.first[self.item[q] + 1]
            left, right = np.zeros(len(p), np.int64), np.full(len(p), gram)
            going = np.ones(len(p), bool)
            while going.any():
                a, b = p - left - 1, q - left - 1
                going &= (a >= doc_low) & (b >= item_low)
                going[going] = words.hash[a[going]] == self.hash[b[going]]
                left += going
            going = np.ones(len(p), bool)
            while going.any():
                a, b = p + right, q + right
                going &= (a < doc_high) & (b < item_high)
                going[going] = words.hash[a[going]] == self.hash[b[going]]
                right += going
            long = left + right >= self.window
            found.append(((p - left)[long], (p + right)[long], self.item[q][long]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


class _View:
    def __init__(self, hash, row):
        self.hash, self.row = hash, row


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans array of (first word, end word), items array of item_id) of every document.

    Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or all of an item with fewer but not none. Spans are
    maximal and disjoint. A null text has no words; nulls and blank items match nothing; items that
    repeat an id count once, and so do repeated texts. Repeated documents are rows of their own.
    Benchmarks of over ``BLOCK_BYTES`` take several passes, whose results are merged by row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    schema = "doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    passes = []
    for block in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}")).toArrow()
        held = spark.sparkContext.broadcast((rows.column("item_id").to_pylist(), Index(rows.column("text").to_pylist(), window, k)))

        def run(batches, held=held):
            names, index = held.value
            for batch in batches:
                n_words, spans, found = [], [], []
                for first, end, data, offs in text_slices(batch.column(1)):
                    words = Words(data, offs, ALNUM)
                    n_words.append(words.count)
                    low, high, item = index.hits(words)
                    own = words.row[low] if len(low) else low
                    at = {r: np.flatnonzero(own == r) for r in np.unique(own).tolist()}
                    for r in range(end - first):
                        i = at.get(r)
                        spans.append([] if i is None else [{"first": int(a - words.first[r]), "end": int(b - words.first[r])} for a, b in merge(low[i], high[i])])
                        found.append([] if i is None else sorted({names[x] for x in item[i].tolist()}))
                if n_words:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

        passes.append((docs if blocks == 1 else source).mapInArrow(lean(run), schema) if blocks == 1 else None)
        if blocks > 1:
            if block == 0:
                source = keep(docs.withColumn("row_key", F.expr("uuid()")), "rows")
            passes[-1] = source.select(F.struct("doc_id", "row_key").alias("key"), "text").mapInArrow(lean(_keyed(run)), "key struct<doc_id:long,row_key:string>, " + schema.partition(", ")[2])
    if blocks == 1:
        return passes[0]
    whole = passes[0]
    for part in passes[1:]:
        whole = whole.unionAll(part)
    merged = whole.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("key.doc_id", "n_words", join_spans("spans").alias("spans"), "items")


def _keyed(run):
    def wrapped(batches):
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, ["key", *out.schema.names[1:]])

    return wrapped


def merge(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint maximal runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def join_spans(column: str):
    """The same as :func:`merge` over an array column of (first, end)."""
    return F.expr(f"""aggregate(array_sort({column}), cast(array() as array<struct<first:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.first <= element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end)))),
           concat(acc, array(x))))""")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least ``least_items`` items occur), items and spans of every document.

    Null and blank texts have no words and no items, as has every text beside an empty benchmark; repeated rows and rows of a
    null id each give a row; other columns are ignored. See :func:`contaminated_spans`.
    """
    found = contaminated_spans(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words",
        F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
        "items", "spans",
    )
