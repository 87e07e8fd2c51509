"""Paths of steps (tag, index, cut_front, cut_back): tweaks with wildcards and end cuts, execution, and printing.

Index -1 is none; a step with cuts takes the children of its tag but the first ``cut_front`` and last ``cut_back``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.operators.candidates import NO_SEED, PAGE, with_texts

STEPS = "array<struct<tag:string,index:int,cut_front:int,cut_back:int>>"


def _step(tag: str, index: str, front: int = 0, back: int = 0) -> str:
    return f"named_struct('tag', {tag}, 'index', {index}, 'cut_front', {front}, 'cut_back', {back})"


def raw_paths(nodes: DataFrame) -> DataFrame:
    """(page_id, root_no, tags, idxs, anys, sibs, alls) of the places that seed paths, each once."""
    return nodes.where("full_text is not null and full_text <> ''").where(~F.col("tag").isin(*NO_SEED)).select(*PAGE, "tags", "idxs", "anys", "sibs", "alls").distinct()


def tweaked(raw: DataFrame, wildcards: int = 0, end_cuts: int = 0, depth: int = 8, advanced: int = 4) -> DataFrame:
    """(page_id, root_no, path): every way to loosen the last ``depth`` steps of the raw paths, the first step excepted.

    A step may lose its index; among the last ``advanced`` ones up to ``end_cuts`` may cut off the first or last of several
    children, and up to ``wildcards`` may take any tag, with its place among all children, and be loosened again.
    """
    def cuts(tag: str) -> str:
        return f"struct({_step(tag, '-1', 1)} as s, 1 as c, {{w}} as w), struct({_step(tag, '-1', 0, 1)} as s, 1 as c, {{w}} as w)"

    plain = f"array(struct({_step('tags[l]', 'if(sibs[l] > 1, idxs[l], -1)')} as s, 0 as c, 0 as w))"
    bare = f"if(l >= greatest(1, size(tags) - {depth}) and sibs[l] > 1, array(struct({_step('tags[l]', '-1')} as s, 0 as c, 0 as w)), array())"
    near = f"l >= greatest(1, size(tags) - {min(advanced, depth)})"
    cut = f"if({near} and sibs[l] > 1, array({cuts('tags[l]').format(w=0)}), array())"
    star = "'*'"
    wild = f"if({near}, if(alls[l] = 1, array(struct({_step(star, '-1')} as s, 0 as c, 1 as w)), array(struct({_step(star, 'anys[l]')} as s, 0 as c, 1 as w), struct({_step(star, '-1')} as s, 0 as c, 1 as w), {cuts(star).format(w=1)})), array())"
    options = f"transform(sequence(0, size(tags) - 1), l -> filter(concat({plain}, {bare}, {cut}, {wild}), o -> o.c <= {end_cuts} and o.w <= {wildcards}))"
    paths = f"""aggregate({options}, array(struct(cast(array() as {STEPS}) as p, 0 as c, 0 as w)), (acc, level) -> flatten(transform(acc, a ->
        transform(filter(level, o -> a.c + o.c <= {end_cuts} and a.w + o.w <= {wildcards}), o -> struct(concat(a.p, array(o.s)) as p, a.c + o.c as c, a.w + o.w as w)))))"""
    return raw.select(*PAGE, F.explode(F.expr(paths)).alias("x")).select(*PAGE, F.col("x.p").alias("path")).distinct()


def fits(path: Column, tags: Column, idxs: Column, anys: Column, sibs: Column, alls: Column) -> Column:
    """Whether a path selects the node of these levels. Of the first step only the tag counts."""
    def level(s: Column, l: Column) -> Column:
        star = s.tag == "*"
        at, n = F.when(star, F.get(anys, l)).otherwise(F.get(idxs, l)), F.when(star, F.get(alls, l)).otherwise(F.get(sibs, l))
        placed = (l == 0) | ((s["index"] == -1) | (s["index"] == at)) & (at >= s.cut_front) & (at < n - s.cut_back)
        return (star | (s.tag == F.get(tags, l))) & placed

    return (F.size(path) == F.size(tags)) & F.forall(F.transform(path, level), lambda ok: ok)


def execute(nodes: DataFrame, paths: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, root_no, path, node_ids, entities) of the paths that select at least ``least`` nodes with text, in document order."""
    live = nodes.where("full_text is not null and full_text <> ''").select(*PAGE, "pre_id", "tags", "idxs", "anys", "sibs", "alls", F.size("tags").alias("n"), F.element_at("tags", -1).alias("last"))
    last = F.element_at("path", -1)["tag"]
    steps = paths.select(*PAGE, "path", F.size("path").alias("n"), last.alias("last"))
    columns = [F.col(c) for c in ("path", "tags", "idxs", "anys", "sibs", "alls")]
    hits = live.join(steps.where("last <> '*'"), [*PAGE, "n", "last"]).where(fits(*columns)).select(*PAGE, "path", "pre_id")
    loose = live.drop("last").join(steps.where("last = '*'").drop("last"), [*PAGE, "n"]).where(fits(*columns)).select(*PAGE, "path", "pre_id")
    found = hits.unionAll(loose).groupBy(*PAGE, "path").agg(F.array_sort(F.collect_list("pre_id")).alias("node_ids")).where(f"size(node_ids) >= {least}")
    return with_texts(found, nodes)


def printed(path: Column) -> Column:
    """/html[1]/body/li[2:]: indices counted from 1, cuts as ranges."""
    def step(s: Column) -> Column:
        cut = F.when(s.cut_front + s.cut_back > 0, F.concat(F.lit("["), F.when(s.cut_front > 0, s.cut_front.cast("string")).otherwise(""), F.lit(":"), F.when(s.cut_back > 0, F.concat(F.lit("-"), s.cut_back.cast("string"))).otherwise(""), F.lit("]")))
        return F.concat(s.tag, F.coalesce(cut, F.when(s["index"] >= 0, F.concat(F.lit("["), (s["index"] + 1).cast("string"), F.lit("]"))), F.lit("")))

    return F.concat(F.lit("/"), F.array_join(F.transform(path, step), "/"))


def steps_of(xpath: Column) -> Column:
    """The steps of a printed path as strings."""
    return F.filter(F.split(xpath, "/"), lambda s: s != "")


def suffix(xpath: Column, length: int) -> Column:
    s = steps_of(xpath)
    return F.slice(s, -F.least(F.lit(length), F.size(s)), F.lit(length))


def prefix_to(xpath: Column, path_depth: Column, depth: Column) -> Column:
    """The steps down to the ancestor at ``depth`` of a node at ``path_depth``."""
    s = steps_of(xpath)
    return F.slice(s, 1, F.size(s) - (path_depth - depth))


def suffix_from(xpath: Column, path_depth: Column, depth: Column) -> Column:
    """The steps below the ancestor at ``depth`` of a node at ``path_depth``."""
    s = steps_of(xpath)
    return F.slice(s, F.size(s) - (path_depth - depth) + 1, path_depth - depth)
