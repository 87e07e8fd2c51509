"""Suffix-array dedup of byte strings repeated anywhere, with linear grouping construction.

Every ``length``-byte window has an anchor, the smallest hashed k-gram in it, which depends on its content
alone: equal windows have equal anchors. Consecutive windows with one anchor form a stretch. Stretches
whose anchor occurs once anywhere are done with; of the others each different one is taken once, and those
of an anchor go into one suffix array. It is built by linear grouping: suffixes are grouped by their
longest Lyndon prefix, groups being taken in descending order and handing their prefix on to the
previous smaller suffix, and then each group's order is emitted from the order of the suffixes that
follow the prefixes, without renaming or recursion.

The array's symbols are runs of words: cuts come after white space that follows a byte of even value. Symbols are
prefix-free, so the order of their suffixes is the order of the bytes. A window belongs to the suffix after the first cut
that its own bytes tell: among windows with equal bytes before that, equal windows are neighbours in the array.
Neighbours are compared byte by byte. Stretches with too long a symbol are cut at all white space, or else into bytes.

An anchor with more than ``SPLIT`` different stretches is split by what its windows have in common: those that
begin within a given range before the anchor share the bytes around it, and only stretches that agree in these
meet in an array, cut to the windows of the range. What is still too large is split by narrower ranges, down to
single windows. So no array grows with the number of copies, and every two equal windows still meet.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.contamination import merge
from weftlist.llm.tables import BROADCAST_IDS, keep, only_ids, parts
from weftlist.llm.words import U, _BYTE, _SALT, _powers, lean, mix, text_slices

GRAM = 32
#: Bytes that a suffix array holds; different stretches of an anchor that meet in one array, and the ranges that more are split by.
ARRAY_BYTES = 1 << 20
SPLIT = 1000
RANGES = (21, 3, 1)
#: How far apart equal anchors are taken for a period.
LONG = 64

_ENDS = b"".join(re.escape(bytes([b])) for b in range(0x22, 0x100, 2))
#: Ways to cut bytes into symbols: a pattern that finds them one after another, the bytes before a cut that decide it, and the longest symbol.
CUTS = ((re.compile(rb"(?s).*?[" + _ENDS + rb"][\x00-\x20]|.+"), 2, 120), (re.compile(rb"[^\x00-\x20]*[\x00-\x20]|[^\x00-\x20]+"), 1, 64), (re.compile(rb"(?s)."), 0, 1))
_KEY = "doc_id long, th long"


def _hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def span_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, of their length too."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * _SALT[62])


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    sums, inverse = _hash_sums(data)
    return mix((sums[k:] - sums[:-k]) * inverse[: len(data) - k + 1]) if len(data) >= k else np.zeros(0, U)


class Stretches:
    """The stretches of some texts: ``row``, first and last window ``low`` and ``high`` counted from the row's start, hashes
    ``anchor`` and ``body``; and in ``own`` (row, low, high) of windows that equal one at most LONG bytes before or behind them.

    A stretch of which every window equals an earlier one at the distance of the last anchor is left out, so a periodic
    text gives a few stretches and not one for each period.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        empty = np.zeros(0, np.int64)
        self.row, self.low, self.high, self.anchor, self.body, self.own = empty, empty, empty, np.zeros(0, U), np.zeros(0, U), (empty,) * 3
        w = length - GRAM + 1
        hashes = window_hashes(data, GRAM)
        n = len(hashes)
        row = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs) - length + 1, 0))
        if n < w or not len(row):
            return
        mask = U((1 << 31) - 1)  # one mask for all slices, so that equal windows agree wherever they lie
        value = (hashes & ~mask) | np.arange(n, dtype=U)
        padded = np.full(-(-n // w) * w, ~U(0))
        padded[:n] = value
        block = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(block, 1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        anchor = (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & mask).astype(np.int64)
        start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offs[:-1], offs[1:]) if b - a >= length])
        at = anchor[start]
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
        low, high = start[new], start[np.append(new[1:], len(start)) - 1]
        row, at = row[new], at[new]
        sums, inverse = _hash_sums(data)
        step = np.diff(at, prepend=at[0])
        again = np.flatnonzero((np.diff(row, prepend=-1) == 0) & (step > 0) & (step <= LONG) & (hashes[at] == np.roll(hashes[at], 1)))
        keep_it = np.ones(len(row), bool)
        if len(again):
            count = high[again] - low[again] + 1
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            windows = np.repeat(low[again] - first, count) + np.arange(count.sum())
            back_to = windows - np.repeat(step[again], count)
            same = back_to >= np.repeat(offs[:-1][row[again]], count)
            same[same] = span_hashes(sums, inverse, windows[same], windows[same] + length) == span_hashes(sums, inverse, back_to[same], back_to[same] + length)
            keep_it[again[np.logical_and.reduceat(same, first)]] = False
            marked = np.zeros(len(data) + 2, np.int8)
            marked[windows[same] + 1] = marked[back_to[same] + 1] = 1
            edge = np.flatnonzero(np.diff(marked))
            a, b = edge[::2], edge[1::2] - 1
            of = np.searchsorted(offs, a, "right") - 1
            self.own = of, a - offs[of], b - offs[of]
        row, low, high, at = row[keep_it], low[keep_it], high[keep_it], at[keep_it]
        self.row, self.anchor, self.body = row, hashes[at], span_hashes(sums, inverse, low, high + length)
        self.low, self.high = low - offs[row], high - offs[row]


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in ascending order, an end being smaller than any symbol."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    width = [1] * len(symbols)  # length of each group's prefix
    below = [g - 1 for g in range(len(symbols))]  # the next smaller group
    above = [g + 1 for g in range(len(symbols))]  # the next larger one
    before = list(range(-1, n - 1))  # previous position; once taken, the way to the nearest smaller suffix
    taken = bytearray(n + 1)
    follows = [0] * n  # where the suffix after the Lyndon prefix starts
    finished: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            size = width[g]
            for i in own:
                taken[i] = 1
                follows[i] = i + size
            hits: dict[int, int] = {}
            for i in own:
                j = before[i]
                if j >= 0 and taken[j]:
                    k = before[j]
                    while k >= 0 and taken[k]:
                        k = before[k]
                    while j >= 0 and taken[j]:
                        before[j], j = k, before[j]
                    j = k
                    before[i] = j
                if j >= 0:
                    hits[j] = hits.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in hits.items():
                moved.setdefault((group[j], times), []).append(j)
            for old, times in sorted(moved, reverse=True):  # more repeats stand higher
                fresh, up = len(members), above[old]
                members.append(moved[old, times])
                width.append(width[old] + times * size)
                below.append(old)
                above.append(up)
                below[up] = above[old] = fresh
                for j in members[fresh]:
                    group[j] = fresh
            finished.append(own)
        g = below[g]
    out, place, top = [0] * n, 0, {}
    for own in reversed(finished):
        top[group[own[0]]] = place
        place += len(own)
    first, beside = [-1] * (n + 1), [-1] * n
    for i in range(n):
        beside[i], first[follows[i]] = first[follows[i]], i
    i = first[n]
    while i >= 0:
        g = group[i]
        out[top[g]] = i
        top[g] += 1
        i = beside[i]
    for at in range(n):
        i = first[out[at]]
        while i >= 0:
            g = group[i]
            out[top[g]] = i
            top[g] += 1
            i = beside[i]
    return out


def _symbols(bodies: list[bytes], cut: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """The bodies' symbols by ascending rank, an end symbol 0 after each body, and where in the joined bytes each symbol starts."""
    split = [cut.findall(b) for b in bodies]
    rank = {token: i + 1 for i, token in enumerate(sorted(set().union(*split)))}
    symbols = np.array([r for tokens in split for r in (*map(rank.__getitem__, tokens), 0)], np.int64)
    lengths = np.array([n for tokens in split for n in (*map(len, tokens), 0)], np.int64)
    return symbols, np.cumsum(lengths) - lengths


def way_to_cut(bodies: list[bytes]) -> int:
    """The first of CUTS with no symbol too long."""
    return next(i for i, (cut, _, most) in enumerate(CUTS) if all(len(token) <= most for b in bodies for token in cut.findall(b)))


def repeats(bodies: list[bytes], length: int, way: int) -> list[np.ndarray]:
    """For each of some byte strings, which of its windows occur at another place in them; ``way`` suits them all."""
    cut, back, _ = CUTS[way]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    starts = ends - [len(b) for b in bodies]
    symbols, place = _symbols(bodies, cut)
    rank = np.zeros(len(data) + 1, np.int64)
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[symbols[order] > 0]
    rank[place[order]] = np.arange(len(order))
    valid = np.zeros(len(data) + 1, np.int8)
    for b, s in zip(bodies, starts):
        valid[s : s + max(len(b) - length + 1, 0)] = 1
    window = np.flatnonzero(valid)
    suffix = window
    if back and len(window):
        first = np.setdiff1d(place[symbols > 0], starts)
        suffix = first[np.searchsorted(first, window + back)]
    before = span_hashes(*_hash_sums(data), window, suffix)
    by = np.lexsort((rank[suffix], before))
    x, y = window[by[:-1]], window[by[1:]]
    near = np.flatnonzero(before[by[:-1]] == before[by[1:]])
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.zeros((0, length), np.uint8)
    for at in (length - 1, length // 2, length * 3 // 4):  # most neighbours that differ do so here
        near = near[data[x[near] + at] == data[y[near] + at]]
    found = np.zeros(len(data), bool)
    for low in range(0, len(near), 4096):
        some = near[low : low + 4096]
        some = some[(view[x[some]] == view[y[some]]).all(1)]
        found[x[some]] = found[y[some]] = True
    return [found[s : s + max(len(b) - length + 1, 0)] for b, s in zip(bodies, starts)]


def _stretch_rows(length: int):
    def run(batches):
        for batch in batches:
            for first, end, data, offs in text_slices(batch.column("text")):
                s = Stretches(data, offs, length)
                row = np.concatenate([s.row, s.own[0]])
                pick = pa.array(first + row)
                pad = np.zeros(len(s.own[0]), U)
                # Windows found already carry their row in place of an anchor.
                h = np.concatenate([s.anchor, mix((first + s.own[0]).astype(U) + pad)]).view(np.int64)
                columns = [pa.array(h), pa.array(np.concatenate([s.body, pad]).view(np.int64)), batch.column("doc_id").take(pick), batch.column("th").take(pick)]
                columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in ((s.low, s.own[1]), (s.high, s.own[2]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(row)) >= len(s.row))], ["h", "bh", "doc_id", "th", "low", "high", "own"])

    return run


def _bodies(length: int):
    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("g", "k", "body")}
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for x in wanted:
                    for name, v in zip(rows, (x["h"], x["bh"], data[x["low"] : x["high"] + length])):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("g", pa.int64()), ("k", pa.int64()), ("body", pa.binary())]))

    return run


def _runs(found: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _arrays(length: int):
    """Rows arrive by (g, k); whole groups share an array of about ARRAY_BYTES."""

    def flush(groups):
        rows = {k: [] for k in ("g", "k", "a", "b")}
        ways = [way_to_cut([body for _, _, body in group]) for group in groups]
        for way in sorted(set(ways)):
            held = [x for group, w in zip(groups, ways) if w == way for x in group]
            for (g, k, _), found in zip(held, repeats([x[2] for x in held], length, way)):
                for a, b in zip(*_runs(found)):
                    for name, v in zip(rows, (g, k, a, b)):
                        rows[name].append(v)
        return pa.RecordBatch.from_pydict(rows, pa.schema([("g", pa.int64()), ("k", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        groups, size, last = [], 0, (None, None)
        for batch in batches:
            for g, k, body in zip(*(batch.column(c).to_pylist() for c in ("g", "k", "body"))):
                if (g, k) == last:  # a row given twice
                    continue
                if g != last[0]:
                    if size > ARRAY_BYTES:
                        yield flush(groups)
                        groups, size = [], 0
                    groups.append([])
                last = g, k
                groups[-1].append((g, k, body))
                size += len(body)
        if groups:
            yield flush(groups)

    return run


def _ranges(length: int, step: int, level: int):
    """The bodies cut to the windows that begin in each range of ``step`` bytes before the anchor, with a group for the bytes these windows share."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("g", "k", "g2", "k2", "at", "body")}
            for g, k, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("g", "k", "anchor", "body"))):
                data = np.frombuffer(body, np.uint8)
                sums, inverse = _hash_sums(data)
                p = int(np.flatnonzero(window_hashes(data, GRAM).view(np.int64) == anchor)[0])
                last = len(body) - length
                for t in range(0, length - GRAM + 1, step):
                    a, b = max(p - t - step + 1, 0), min(p - t, last)
                    if a <= b:
                        begin, end = np.array([p - t, a]), np.array([p - t - step + 1 + length, b + length])
                        shared, whole = span_hashes(sums, inverse, begin, end)
                        group = np.bitwise_xor.reduce(mix(np.array([shared, t, g % 2**64], U) * _SALT[level : level + 3]))
                        for name, v in zip(rows, (g, k, int(group.view(np.int64)), int(whole.view(np.int64)), a, body[a : b + length])):
                            rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("g", pa.int64()), ("k", pa.int64()), ("g2", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("body", pa.binary())]))

    return run


def shared_windows(bodies: DataFrame, length: int, split: int = SPLIT, level: int = 0) -> DataFrame:
    """(g, k, a, b): windows a to b of the different bodies (g, k, anchor, body) that another body of the same group g has too.

    The same (g, k) may be given more than once.
    """
    spark = bodies.sparkSession
    kinds = bodies.select("g", "k").distinct().groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = keep(kinds, "kinds")
    met = bodies.join(kinds, "g")
    rows = met.where(f"kinds <= {split}").select("g", "k", "body").repartition(parts(spark), "g").sortWithinPartitions("g", "k")
    out = rows.mapInArrow(lean(_arrays(length)), "g long, k long, a int, b int")
    if level == len(RANGES) or kinds.where(f"kinds > {split}").isEmpty():
        return out
    large = met.where(f"kinds > {split}").select("g", "k", "anchor", "body").dropDuplicates(["g", "k"])
    cut = keep(large.mapInArrow(lean(_ranges(length, RANGES[level], level)), "g long, k long, g2 long, k2 long, at int, body binary").join(large.select("g", "k", "anchor"), ["g", "k"]), "cut")
    # One length of body for each (g2, k2): equal hashes of whole cut bodies are equal bodies.
    each = cut.groupBy("g2", "k2").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.first("body").alias("body"))
    each = keep(each, "each")
    found = shared_windows(each.select(F.col("g2").alias("g"), F.col("k2").alias("k"), "anchor", "body"), length, split, level + 1)
    whole = each.where("n > 1").select(F.col("g2").alias("g"), F.col("k2").alias("k"), F.lit(0).alias("a"), F.expr(f"octet_length(body) - {length}").alias("b"))
    found = found.unionByName(whole).withColumnsRenamed({"g": "g2", "k": "k2"})
    return out.unionAll(cut.select("g", "k", "g2", "k2", "at").join(found, ["g2", "k2"]).select("g", "k", F.expr("a + at"), F.expr("b + at")))


def repeated_spans(docs: DataFrame, length: int = 200, split: int = SPLIT) -> DataFrame:
    """(doc_id, th, spans) of the rows of (doc_id, th, text) with bytes that a repeated ``length``-byte string covers."""
    rows = keep(docs.mapInArrow(lean(_stretch_rows(length)), f"h long, bh long, {_KEY}, low int, high int, own boolean"), "rows")
    # Anchors that occur twice, and whether different stretches have them.
    often = rows.where("not own").groupBy("h").agg(F.count("*").alias("n"), F.min("bh").alias("x"), F.max("bh").alias("y")).where("n > 1").select("h", F.expr("x <> y").alias("mixed"))
    hits = keep(rows.join(often, "h", "left").where("own or mixed is not null").withColumn("mixed", F.expr("not own and mixed")), "stretches")
    kinds = keep(hits.where("mixed").groupBy("h", "bh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "low", "high")).alias("r")), "kinds")
    wanted = keep(kinds.groupBy("r.doc_id", "r.th").agg(F.collect_list(F.struct("h", "bh", "r.low", "r.high")).alias("wanted")), "wanted")
    bodies = only_ids(docs, wanted.select("doc_id").distinct()).join(wanted, ["doc_id", "th"]).mapInArrow(lean(_bodies(length)), "g long, k long, body binary")
    bodies = keep(bodies, "bodies").withColumn("anchor", F.col("g"))
    ranges = shared_windows(bodies, length, split).unionAll(kinds.where("n > 1").select("h", "bh", F.lit(0), F.expr("r.high - r.low")))
    ranges = ranges.withColumnsRenamed({"g": "h", "k": "bh"})
    found = hits.where("mixed").join(ranges, ["h", "bh"]).select("doc_id", "th", F.struct((F.col("low") + F.col("a")).alias("a"), (F.col("low") + F.col("b") + length).alias("b")).alias("x"))
    whole = hits.where("not mixed").select("doc_id", "th", F.struct(F.col("low").alias("a"), (F.col("high") + length).alias("b")).alias("x"))
    return found.unionAll(whole).groupBy("doc_id", "th").agg(F.collect_set("x").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, removed array of (a, b)) of every row.

    Texts are their UTF-8 bytes, a null is empty. Removed is every byte covered by a ``length``-byte string that also
    starts anywhere else in the table, its own text included; strings are judged on the input. Texts under
    ``length`` bytes stay whole. Repeated rows are repeats of each other. What is kept need not be valid UTF-8. Rows of a
    null id keep it. ``split`` bounds the stretches that meet in a suffix array and doesn't change the result. Stretches
    are the same if two 64-bit hashes agree, of the anchor and of all bytes. Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows are told apart by id, and by text where ids repeat.
    again = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    docs = docs.withColumn("th", F.xxhash64("text") if again else F.lit(0).cast("long"))
    spans = keep(repeated_spans(docs, length, split), "spans")
    ids = spans.select("doc_id").distinct()

    def cut(batches):
        for batch in batches:
            rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "removed")}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, gone = text.encode(), merge(np.array([x["a"] for x in own or []]), np.array([x["b"] for x in own or []]))
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                for name, v in zip(rows, (len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept), [{"a": a, "b": b} for a, b in gone])):
                    rows[name].append(v)
            out = pa.RecordBatch.from_pydict(rows, pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", *out.schema.names])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<a:int,b:int>>"
    if ids.count() <= BROADCAST_IDS:  # only texts with spans are moved
        ids = F.broadcast(ids)
        out = docs.join(ids, "doc_id", "left_semi").join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(lean(cut), schema)
        rest = docs.join(ids, "doc_id", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("removed"))
        out = out.unionByName(rest)
    else:
        out = docs.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(lean(cut), schema)
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {-(2**63)})"))
