"""Line dedup by content-defined chunks, in DataFrame operations only.

A text is its lines. A chunk ends after a line when the rolling hash over the hashes of that line and the one
before it falls under a threshold, so boundaries depend on nearby content and survive shifts. Chunks of several lines that
occur more than once anywhere are removed except for their first occurrence, by (doc_id, place).
Hashes only choose candidates: the chunks' bytes decide.

``dedup_lines`` compares such chunks as wholes and is what the SQL states. ``dedup_passages`` starts from the same chunks and
extends what repeats over the equal lines beside and between them, so that repeated runs go whole wherever they start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.tables import BROADCAST_IDS, boxed, fence, keep, only_ids, plan_bytes, unboxed

#: Bytes of first occurrences that are broadcast at most.
FIRST_BYTES = 16 << 20
#: A boundary follows a line if the first hex digit of the rolling hash is below this digit: one line in four.
CUT = "4"


def _cut(docs: DataFrame) -> DataFrame:
    """Adds ``_row`` (hash of the whole text), ``_lines`` and ``_ends`` (the last line of each chunk)."""
    docs = fence(docs, "_lines", F.split("text", "\n", -1))
    docs = fence(docs, "_hashes", "transform(_lines, x -> md5(x))")
    docs = fence(docs, "_ends", f"filter(sequence(0, coalesce(size(_hashes), 1) - 1), i -> i = size(_hashes) - 1 or substring(md5(concat(if(i = 0, '', _hashes[i - 1]), _hashes[i])), 1, 1) < '{CUT}')")
    return docs.withColumn("_row", F.xxhash64("text")).drop("_hashes")


def _chunked(docs: DataFrame) -> DataFrame:
    """Adds ``_row`` and ``_chunks`` (arrays of lines)."""
    docs = fence(_cut(docs), "_chunks", "transform(_ends, (e, j) -> slice(_lines, if(j = 0, 1, _ends[j - 1] + 2), if(j = 0, e + 1, e - _ends[j - 1])))")
    return docs.drop("_lines", "_ends")


def _small(first: DataFrame) -> DataFrame:
    """First occurrences, to be broadcast where they take few bytes: a passage that very many texts have then stays spread over all tasks. More of them are joined by shuffle."""
    first = keep(first, "first")
    return F.broadcast(first) if plan_bytes(first) <= FIRST_BYTES else first


def dedup_lines(docs: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut from the text column, and n_lines, n_removed (lines).

    Removed lines leave no trace; the rest is joined by line ends again. A null text stays null (no lines). Rows that
    repeat id and text count as one document and stay alike; of different texts under one id each is its own. Rows of
    a null id keep their text. Chunks of fewer than ``least_lines`` lines are never removed. Other columns pass
    through whatever their names; given columns n_lines and n_removed make room for the new ones, which come last. Tables may be empty.
    """
    given, docs = docs, boxed(docs, doc_id=id_col, text=text_col)
    rows = _chunked(docs.select("doc_id", "text").where("text is not null and doc_id is not null"))
    chunks = rows.select("doc_id", "_row", F.posexplode("_chunks").alias("place", "lines")).where(f"size(lines) >= {least_lines}")
    chunks = chunks.select("doc_id", "_row", "place", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("chunk")).withColumn("hash", F.xxhash64("chunk"))
    often = keep(chunks.select("hash", F.struct("doc_id", "_row", "place").alias("at")).groupBy("hash").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("hash"), "often")
    again = keep(only_ids(chunks, often, "hash"), "again")
    first = _small(again.groupBy("hash", "chunk").agg(F.min(F.struct("doc_id", "place", "_row")).alias("first")))
    # The least of (id, text hash) wherever equal ids carry different texts.
    gone = again.join(first, ["hash", "chunk"]).where("struct(doc_id, place, _row) <> first").groupBy("doc_id", "_row").agg(F.array_distinct(F.collect_list("place")).alias("_gone"))
    gone = keep(gone, "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = _chunked(docs).join(gone, ["doc_id", "_row"], "left")
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr("array_join(flatten(filter(_chunks, (c, i) -> not array_contains(_gone, i))), '\n')"))
    out = out.withColumn("n_lines", F.expr("coalesce(aggregate(_chunks, 0L, (a, c) -> a + size(c)), 0L)")).withColumn("n_removed", F.expr("coalesce(aggregate(_gone, 0L, (a, i) -> a + size(_chunks[i])), 0L)"))
    return unboxed(out.withColumn("text", kept), given, "n_lines", "n_removed", **{text_col: "text"})


def _later(pieces: DataFrame, name: str) -> DataFrame:
    """The rows of ``pieces`` (doc_id, _row, place, piece, ..) whose piece also starts at an earlier (doc_id, place), with that place as ``first``."""
    pieces = pieces.withColumn("hash", F.xxhash64("piece"))
    often = keep(pieces.select("hash", F.struct("doc_id", "_row", "place").alias("at")).groupBy("hash").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("hash"), f"often_{name}")
    again = keep(only_ids(pieces, often, "hash"), f"again_{name}")
    first = _small(again.groupBy("hash", "piece").agg(F.min(F.struct("doc_id", "place", "_row")).alias("first")))
    return again.join(first, ["hash", "piece"]).where("struct(doc_id, place, _row) <> first")


def _by_text(lines: DataFrame, name: str) -> DataFrame:
    """Line numbers gathered for each text, to be broadcast where few texts have any."""
    lists = keep(lines.groupBy("doc_id", "_row").agg(F.collect_set("line").alias(f"_{name}")), name)
    return F.broadcast(lists) if lists.count() <= BROADCAST_IDS // 50 else lists


def dedup_passages(docs: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later occurrences of runs of ``least_lines`` lines or more, and n_lines, n_removed (lines).

    A run goes if an equal run starts earlier, by (doc_id, place), in any text; runs are judged on the input.
    Content-defined chunks that equal an earlier one go first, as wholes. The boundaries in a repeated run follow
    from the run but for the one after its first line, so what is left of it lies at its ends, or the run is shorter than a
    chunk: all windows of ``least_lines`` lines that are not inside such a chunk are then compared. The first occurrence
    of a window never is inside one. A longer run is repeated exactly if all its windows are, so these,
    extended over one another and over the chunks, give whole runs. Of a run that overlaps its own first
    occurrence only the lines after that go. The first occurrence of every line stays. Rows, null texts,
    null ids and other columns are treated as in ``dedup_lines``.
    """
    given, docs = docs, boxed(docs, doc_id=id_col, text=text_col)
    k = int(least_lines)
    rows = _cut(docs.select("doc_id", "text").where("text is not null and doc_id is not null")).drop("text").where(f"size(_lines) >= {k}")
    chunks = rows.select("doc_id", "_row", "_lines", F.inline(F.expr("transform(_ends, (e, j) -> struct(if(j = 0, 0, _ends[j - 1] + 1) as place, e as last))"))).where(f"last - place >= {k - 1}")
    chunks = chunks.select("doc_id", "_row", "place", "last", F.expr("array_join(slice(_lines, place + 1, last - place + 1), '\n')").alias("piece"))
    chunks = keep(_later(chunks, "chunks").select("doc_id", "_row", "place", "last"), "copied")
    inside = _by_text(chunks.select("doc_id", "_row", F.explode(F.expr(f"sequence(place, last - {k - 1})")).alias("line")), "inside")

    rows = fence(rows.join(inside, ["doc_id", "_row"], "left"), "_starts", f"array_except(sequence(0, size(_lines) - {k}), coalesce(_inside, array()))")
    windows = rows.select("doc_id", "_row", F.inline(F.expr(f"transform(_starts, i -> struct(i as place, array_join(slice(_lines, i + 1, {k}), '\n') as piece))")))
    start = F.expr(f"if(doc_id = first.doc_id and _row = first._row, greatest(place, first.place + {k}), place)")
    lines = _later(windows, "windows").select("doc_id", "_row", F.explode(F.sequence(start, F.expr(f"place + {k - 1}"))).alias("line"))
    gone = _by_text(lines.unionAll(chunks.select("doc_id", "_row", F.explode(F.sequence("place", "last")).alias("line"))), "gone")
    out = fence(docs.withColumn("_row", F.xxhash64("text")).join(gone, ["doc_id", "_row"], "left"), "_lines", F.split("text", "\n", -1))
    out = out.withColumn("n_lines", F.expr("if(text is null, 0L, cast(size(_lines) as bigint))")).withColumn("n_removed", F.expr("if(_gone is null, 0L, cast(size(_gone) as bigint))"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')"))
    return unboxed(out.withColumn("text", kept), given, "n_lines", "n_removed", **{text_col: "text"})


ORACLE = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
cuts AS (SELECT *, CASE WHEN substr(md5(coalesce(md5(lag(line) OVER w), '') || md5(line)), 1, 1) < '{CUT}' THEN 1 ELSE 0 END AS cut FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM cuts),
chunks AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM places GROUP BY doc_id, place),
seen AS (SELECT *, row_number() OVER (PARTITION BY chunk, n ORDER BY doc_id, place) AS nth FROM chunks),
kept AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (n >= 2 AND nth > 1), 0) AS BIGINT) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT (n >= 2 AND nth > 1)), '') AS text FROM seen GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
