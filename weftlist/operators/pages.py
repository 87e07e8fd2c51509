"""Candidate lists and groups straight from pages: each page is parsed once, and its lists are made where it was parsed.

The lists are those of ``candidates.candidates`` and ``candidates.groups``, whose joins on page and root are look-ups here.
"""

from __future__ import annotations

import gc
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.functions import text
from weftlist.operators.candidates import NO_SEED, PAGE
from weftlist.sources import html

# Places of the node table's columns in a row.
AT = {n: i for i, n in enumerate(html.ARROW.names)}
PRE, PARENT, TAG, TEXT, TAGS, IDXS, SIBS, ATTRS = (AT[n] for n in ("pre_id", "parent_id", "tag", "full_text", "tags", "idxs", "sibs", "attrs"))
#: What features look at of a node on a level above a group: from the row as it is, and the values of two attributes and the tag above.
COPIED = ("pre_id", "parent_id", "depth", "tag", "child_idx", "child_idx_tag", "n_sib", "n_sib_tag", "n_children")
LEVEL = pa.struct([("level", pa.int32()), *((n, html.ARROW.field(n).type) for n in COPIED), ("id", pa.string()), ("class", pa.string()), ("above", pa.string())])
STRINGS, NUMBERS = pa.list_(pa.string()), pa.list_(pa.int32())
LISTS = pa.schema([("page_id", pa.int64()), ("root_no", pa.int32()), ("xpath", pa.string()), ("node_ids", NUMBERS), ("entities", STRINGS)])
GROUPS = pa.schema([("page_id", pa.int64()), ("root_no", pa.int32()), ("n_nodes", pa.int64()), ("node_ids", NUMBERS), ("entities", STRINGS), ("xpaths", STRINGS)])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", NUMBERS: "array<int>", STRINGS: "array<string>"}
    names[pa.list_(LEVEL)] = f"array<struct<{', '.join(f'{f.name}: {names[f.type]}' for f in LEVEL)}>>"
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def lists_of(rows: list[tuple], depth: int, least: int) -> list[tuple[str, list[int]]]:
    """(xpath, node_ids) of one tree's rows in document order; the rules are those of ``candidates.candidates``."""
    alike: dict[tuple, list[tuple]] = {}
    for r in rows:
        if r[TEXT]:
            alike.setdefault(tuple(r[TAGS]), []).append(r)
    out = []
    for tags, live in alike.items():
        if len(live) < least or tags[-1] in NO_SEED:  # all have the same tag, so all seed or none
            continue
        low, n = len(tags) - depth, len(tags)
        keeps = [tuple(level for level in range(1, n) if r[SIBS][level] > 1) for r in live]
        # The masks of each shape; a node is a seed of those of its own shape.
        masks: dict[tuple, set[tuple]] = {}
        for keep in set(keeps):
            fixed, free = tuple(x for x in keep if x < low), [x for x in keep if x >= low]
            for size in range(len(free) + 1):
                for some in combinations(free, size):
                    masks.setdefault(fixed + some, set()).add(keep)
        for mask, own in masks.items():
            found: dict[tuple, list[int]] = {}
            for i, r in enumerate(live):
                idxs = r[IDXS]
                found.setdefault(tuple([idxs[level] for level in mask]), []).append(i)
            for key, at in found.items():
                if len(at) >= least and any(keeps[i] in own for i in at):
                    places = dict(zip(mask, key))
                    steps = [f"{t}[{places[k] + 1}]" if k in places else t for k, t in enumerate(tags)]
                    steps[0] = f"{tags[0]}[{live[0][AT['root_no']] + 1}]"
                    out.append(("/" + "/".join(steps), [live[i][PRE] for i in at]))
    return out


def _climb(rows: list[tuple], ids: list[int], depth: int) -> list[tuple]:
    """The selected nodes at level 0 and, each once, their ancestors up to ``depth`` levels."""
    out, now = [], dict.fromkeys(ids)
    for level in range(depth):
        out += [(level, rows[i]) for i in now]
        now = dict.fromkeys(p for i in now if (p := rows[i][PARENT]) is not None)
    return out


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    """As pa.array of lists without nulls, by their lengths and values."""
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), pa.array([x for v in values for x in v], kind.value_type))


def _levels(values: list[list[tuple]]) -> pa.Array:
    flat = [x for v in values for x in v]
    columns = [pa.array([level for level, _ in flat], pa.int32())]
    columns += [pa.array([r[AT[n]] for _, r in flat], html.ARROW.field(n).type) for n in COPIED]
    found = [dict(r[ATTRS]) for _, r in flat]
    columns += [pa.array([a.get(n) for a in found], pa.string()) for n in ("id", "class")]
    columns += [pa.array([r[TAGS][-2] if len(r[TAGS]) > 1 else None for _, r in flat], pa.string())]
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(LEVEL)))


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [f.type for f in schema]
    columns = [_levels(c) if k == pa.list_(LEVEL) else _lists(c, k) if pa.types.is_list(k) else pa.array(c, k) for c, k in zip(zip(*held), kinds)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _mapped(pages: DataFrame, schema: pa.Schema, of_tree) -> DataFrame:
    """Rows that ``of_tree(page_id, root_no, rows)`` gives for the trees of each page, before and after the line-break repair."""

    ids = schema.get_field_index("node_ids")

    def run(batches):
        gc.disable()  # trees and rows have no cycles
        try:
            held: list[tuple] = []
            weight = 0
            for batch in batches:
                for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows = html.rows_of(page_id, source)
                    second = next(i for i in range(1, len(rows)) if rows[i][PRE] == 0)
                    for root_no, tree in enumerate((rows[:second], rows[second:])):
                        for made in of_tree(page_id, root_no, tree):
                            held.append(made)
                            weight += len(made[ids])
                            if weight > 20_000:
                                yield _batch(held, schema)
                                held, weight = [], 0
            if held:
                yield _batch(held, schema)
        finally:
            gc.enable()

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, _ddl(schema))


def candidates(pages: DataFrame, depth: int = 8, least: int = 3) -> DataFrame:
    """(page_id, root_no, xpath, node_ids, entities) of pages (page_id, html)."""

    def of_tree(page_id, root_no, rows):
        for path, ids in lists_of(rows, depth, least):
            yield page_id, root_no, path, ids, [rows[i][TEXT] for i in ids]

    return _mapped(pages, LISTS, of_tree)


def groups(pages: DataFrame, level: int = 0, depth: int = 8, least: int = 3, climb: int = 0) -> DataFrame:
    """(page_id, root_no, group_id, n_nodes, node_ids, entities, xpaths): candidates with equal node lists as one group, with the number of nodes of their page, and strings normalised at ``level``.

    With ``climb`` also ``levels``, the nodes of as many levels from the group's own upwards, each once.
    """
    schema = GROUPS.append(pa.field("levels", pa.list_(LEVEL))) if climb else GROUPS
    marks = level < 2

    def of_tree(page_id, root_no, rows):
        paths: dict[tuple, list[str]] = {}
        for path, ids in lists_of(rows, depth, least):
            paths.setdefault(tuple(ids), []).append(path)
        strip = (lambda x: x) if marks else text.without_marks
        for ids, p in paths.items():
            yield page_id, root_no, len(rows), list(ids), [strip(rows[i][TEXT]) for i in ids], sorted(p), *([_climb(rows, ids, climb)] if climb else [])

    out = _mapped(pages, schema, of_tree).withColumn("group_id", F.xxhash64("node_ids"))
    return out.withColumn("entities", F.transform("entities", lambda e: text.normalize(e, level, marks=False))) if level else out


def levels(grouped: DataFrame) -> DataFrame:
    """(keys, level, node columns) of groups with ``levels``, as ``features.levels`` gives."""
    rows = grouped.select(*PAGE, "group_id", F.inline("levels"))
    attrs = F.create_map(F.lit("id"), F.col("id"), F.lit("class"), F.col("class"))
    return rows.withColumns({"attrs": attrs, "tags": F.array("above", "tag")}).drop("id", "class", "above")
