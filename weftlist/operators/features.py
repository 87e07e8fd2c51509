"""Features of candidates and candidate groups: long tables (keys, feature, value) in which repeats add up.

A feature's name is "domain :: name". Groups are (page_id, root_no, group_id, node_ids, entities).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.functions import stats, text

KEYS = ["page_id", "root_no", "group_id"]


def bag(df: DataFrame, keys: list[str]) -> DataFrame:
    """Equal features of a key added up."""
    return df.groupBy(*keys, "feature").agg(F.sum("value").alias("value"))


def _steps(name: Column, steps: Column, unit: str = "") -> Column:
    return F.transform(steps, lambda i: F.concat(name, F.lit(" >= "), i.cast("int").cast("string"), F.lit(unit)))


def _none() -> Column:
    return F.array().cast("array<string>")


def entropy_features(name: Column, entropy: Column, bins: bool) -> Column:
    """(feature, value) of a normalised entropy above 0: the number itself, or its bin of ten."""
    named = F.concat(name, F.lit("-normalized-entropy"))
    if bins:
        low = stats.bin_of(entropy)
        named = F.concat(named, F.lit(" in ["), low.cast("string"), F.lit("/10,"), (low + 1).cast("string"), F.lit("/10]"))
    value = F.lit(1.0) if bins else entropy
    return F.when(entropy > 0, F.array(F.struct(named.alias("f"), value.alias("v")))).otherwise(F.array().cast("array<struct<f:string,v:double>>"))


def voting(occurrences: DataFrame, keys: list[str], domain: str, least_ratio: float = 0.0, diverse: bool = False, bins: bool = False, aggregate: bool = True) -> DataFrame:
    """Votes of multisets given as rows (keys, name, value, words, lone, only_entropy).

    Emitted are the normalised entropy if it isn't 0, steps of the share of the one most frequent value, whether that
    share is at least 0.9, and the value itself, as its words with ``words``; with ``lone`` also when the multiset
    has a single element. Ties have no winner, nor has a share under ``least_ratio``, which ``diverse`` marks.
    ``only_entropy`` stops after the entropy. Null values are left out. Without ``aggregate`` each value is a feature.
    """
    if not aggregate:
        each = occurrences.where("value is not null").select(*keys, F.concat(F.lit(f"{domain} :: "), "name", F.lit(" = "), "value").alias("feature"))
        return each.groupBy(*keys, "feature").agg(F.count("*").cast("double").alias("value"))
    by = [*keys, "name", "words", "lone", "only_entropy"]
    counts = occurrences.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("c"))
    # The largest and the smallest of the most frequent values are one if and only if there is no tie.
    g = counts.groupBy(*by).agg(
        F.sum("c").alias("size"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.ln("c")).alias("clnc"),
        F.max(F.struct("c", "value")).alias("high"), F.min(F.struct(-F.col("c"), "value")).alias("low"),
    )
    top, n = F.col("high.value"), F.col("name")
    ratio = F.col("high.c") / F.col("size")
    entropy = F.when(F.col("kinds") > 1, 1 - F.col("clnc") / F.col("size") / F.ln("size"))
    won = (top == F.col("low.value")) & ~F.col("only_entropy")
    value = F.when(F.col("words"), F.transform(text.bag_of_words(top), lambda w: F.concat(n, F.lit("-majority ~ "), w)))
    value = value.when((F.col("size") > 1) | F.col("lone"), F.array(F.concat(n, F.lit("-majority = "), top))).otherwise(_none())
    alike = F.when(ratio >= 0.9, F.array(F.concat(n, F.when(F.col("size") > 1, "-identical").otherwise("-single")))).otherwise(_none())
    spread = F.array(F.concat(n, F.lit("-diverse"))) if diverse else _none()
    names = F.when(won, F.concat(_steps(F.concat(n, F.lit("-majority-ratio")), stats.percents(ratio), "%"), F.when(ratio < least_ratio, spread).otherwise(F.concat(alike, value)))).otherwise(_none())
    pairs = F.concat(entropy_features(n, entropy, bins), F.transform(names, lambda f: F.struct(f.alias("f"), F.lit(1.0).alias("v"))))
    return g.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.concat(F.lit(f"{domain} :: "), "p.f").alias("feature"), F.col("p.v").alias("value"))


def indicators(df: DataFrame, keys: list[str], domain: str, names: Column) -> DataFrame:
    """A feature of value 1 for each string of the array ``names``."""
    return df.select(*keys, F.explode(names).alias("f")).select(*keys, F.concat(F.lit(f"{domain} :: "), "f").alias("feature"), F.lit(1.0).alias("value"))


def _occurrence(name: str, value: Column, words: bool = False, lone: bool = True, only_entropy: bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(words).alias("words"), F.lit(lone).alias("lone"), F.lit(only_entropy).alias("only_entropy"))


def levels(nodes: DataFrame, groups: DataFrame, depth: int = 5) -> DataFrame:
    """(keys, level, node columns): the selected nodes at level 0 and, each once, their ancestors up to ``depth`` levels."""
    own = groups.select(*KEYS, F.explode("node_ids").alias("pre_id"))
    paths = nodes.select("page_id", "root_no", "pre_id", F.slice(F.reverse(F.concat("ancestors", F.array("pre_id"))), 1, depth).alias("up"))
    reached = own.join(paths, ["page_id", "root_no", "pre_id"]).select(*KEYS, F.posexplode("up").alias("level", "pre_id")).distinct()
    return reached.join(nodes, ["page_id", "root_no", "pre_id"])


def self_or_ancestors(nodes: DataFrame, groups: DataFrame, plain: bool = True, indexed: bool = False, names: bool = True, average: bool = False, depth: int = 5) -> DataFrame:
    """Votes on tag, id, class, number of children and place of the nodes at each level; empty ids and classes don't vote. The climb ends at the page's root element.

    ``plain`` names add up over levels, ``indexed`` ones begin with (n-level)-; ``names=False`` leaves out ids and classes, ``average`` divides values by ``depth``.
    """
    return ancestor_votes(levels(nodes, groups, depth), plain, indexed, names, average, depth)


def ancestor_votes(n: DataFrame, plain: bool = True, indexed: bool = False, names: bool = True, average: bool = False, depth: int = 5) -> DataFrame:
    """``self_or_ancestors`` of the nodes at each level, as ``levels`` gives them."""
    many = F.when(F.col("n_children") <= 3, F.col("n_children").cast("string")).otherwise("many")
    votes = [_occurrence("tag", F.col("tag")), _occurrence("num-children", many), _occurrence("child-index", F.col("child_idx"), lone=False)]
    votes += [_occurrence(a, F.nullif(F.col("attrs")[a], F.lit("")), words=True) for a in ("id", "class")] if names else []
    out = voting(n.select(*KEYS, "level", F.inline(F.array(*votes))), [*KEYS, "level"], "self-or-ancestors")
    parents = n.groupBy(*KEYS, "level", F.coalesce("parent_id", F.lit(-1)).alias("parent")).agg(F.count("*").alias("own"), F.max("n_sib").alias("all"))
    per = parents.groupBy(*KEYS, "level").agg((F.sum("own") / F.sum("all")).alias("share"), F.count("*").alias("parents"))
    extra = F.concat(_steps(F.lit("children-of-parent"), stats.percents(F.col("share")), "%"), F.when(F.col("parents") == 1, F.array(F.lit("same-parent"))).otherwise(_none()))
    out = out.unionByName(indicators(per, [*KEYS, "level"], "self-or-ancestors", extra))
    at = F.concat(F.lit("self-or-ancestors :: (n-"), F.col("level").cast("string"), F.lit(")-"), F.substring_index("feature", " :: ", -1))
    kinds = ([F.col("feature")] if plain else []) + ([at] if indexed else [])
    out = out.withColumn("feature", F.explode(F.array(*kinds))).withColumn("value", F.col("value") / (depth if average else 1))
    return bag(out.select(*KEYS, "feature", "value"), KEYS)


def node_range(nodes: DataFrame, groups: DataFrame, collapsed: bool = True) -> DataFrame:
    """Where a group's first and last nodes stand among its page's nodes, counted from 1 in document order, and how far apart; with ``collapsed=False`` by the times of entering the first and leaving the last."""
    low, high, n = F.array_min("node_ids") + 1, F.array_max("node_ids") + 1, F.col("n")
    if collapsed:
        rows = groups.join(nodes.groupBy("page_id", "root_no").agg(F.count("*").alias("n")), ["page_id", "root_no"])
    else:
        times = nodes.select("page_id", "root_no", F.col("pre_id"), "ts_in", "ts_out")
        ends = groups.select(*KEYS, "node_ids", F.array_min("node_ids").alias("pre_id")).join(times.drop("ts_out"), ["page_id", "root_no", "pre_id"]).withColumn("pre_id", F.array_max("node_ids")).join(times.drop("ts_in"), ["page_id", "root_no", "pre_id"])
        rows, low, high = ends.join(nodes.groupBy("page_id", "root_no").agg(F.max("ts_out").alias("n")), ["page_id", "root_no"]), F.col("ts_in"), F.col("ts_out")
    return places(rows, low, high, n)


def places(rows: DataFrame, low: Column, high: Column, n: Column) -> DataFrame:
    """``node_range`` of groups that have their first and last places and the number of places."""
    names = F.concat(*(_steps(F.lit(k), stats.percents(v / n), "%") for k, v in (("length", high - low), ("start", low), ("end", high))))
    return indicators(rows, KEYS, "node-range", names)


def hole(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether the selected nodes of a level leave out children at the top, middle or bottom of their parents, of all children and of those of their tag."""
    return holes(levels(nodes, groups))


def holes(n: DataFrame) -> DataFrame:
    """``hole`` of the nodes at each level, as ``levels`` gives them."""
    n = n.where("depth > 2")
    edge = [F.count("*").alias("n"), F.first("n_sib").alias("all_any"), F.first("n_sib_tag").alias("all_tag"), F.min(F.struct("pre_id", F.element_at("tags", -2).alias("parent"), "tag")).alias("first")]
    for kind, column in (("any", "child_idx"), ("tag", "child_idx_tag")):
        edge += [F.min(column).alias(f"low_{kind}"), F.max(column).alias(f"high_{kind}")]
    per = n.groupBy(*KEYS, "level", "parent_id").agg(*edge)
    flags = {"single": "n = 1"}
    for kind in ("any", "tag"):
        flags |= {f"{kind}-all": f"n > 1 and n = all_{kind}", f"{kind}-hole-top": f"low_{kind} > 0", f"{kind}-hole-middle": f"high_{kind} - low_{kind} + 1 <> n", f"{kind}-hole-bottom": f"high_{kind} < all_{kind} - 1"}
    level = per.groupBy(*KEYS, "level").agg(F.min("first").alias("first"), *[F.bool_or(F.expr(c)).alias(k) for k, c in flags.items()])
    names = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags]), lambda k: k.isNotNull())
    out = level.select(*KEYS, "first", F.explode(names).alias("f"))
    return bag(out.select(*KEYS, F.concat(F.lit("hole :: "), "first.parent", F.lit("/"), "first.tag", F.lit("-"), "f").alias("feature"), F.lit(1.0).alias("value")), KEYS)


def path_tail(cands: DataFrame, keys: list[str], depth: int = 5) -> DataFrame:
    """The last steps of a candidate's path: the bare suffix, and of each step its tag and whether it has an index."""
    steps = F.filter(F.split("xpath", "/"), lambda s: s != "")
    rows = cands.select(*keys, steps.alias("steps")).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("steps")))))
    step = F.element_at("steps", -F.col("k"))
    tag, indexed = F.regexp_replace(step, r"\[.*", ""), F.contains(step, F.lit("[")).cast("string")
    at = F.concat(F.lit("(n-"), F.col("k").cast("string"), F.lit(")-"))
    bare = F.array_join(F.transform(F.slice("steps", -F.col("k"), F.col("k")), lambda s: F.regexp_replace(s, r"\[.*", "")), "/")
    names = F.array(F.concat(F.lit("/"), bare), F.concat(at, F.lit("tag = "), tag), F.concat(at, F.lit("indexed = "), indexed), F.concat(at, F.lit("tag-indexed = "), tag, F.lit(" "), indexed))
    return rows.select(*keys, F.explode(names).alias("f")).select(*keys, F.concat(F.lit("path-tail :: "), "f").alias("feature"), F.lit(1.0).alias("value"))


def entity(groups: DataFrame, count: bool = False, phrase: bool = True, collapsed: bool = False, words: bool = True, mean: bool = True, steps: bool = True) -> DataFrame:
    """Entropy and repeats of the strings, votes on their words' shapes and number, and that number's mean and deviation.

    ``count`` adds steps of the list's length, ``collapsed`` votes on shapes without repeated words; ``steps=False`` gives mean and deviation as numbers.
    """
    e = groups.select(*KEYS, F.explode("entities").alias("e")).withColumn("shape", text.phrase_shape(F.col("e"))).withColumn("words", text.java_split(F.col("shape"), " "))
    rows = [_occurrence("entity", F.col("e"), only_entropy=True)]
    rows += [_occurrence("phrase-shape", F.col("shape"))] if phrase else []
    rows += [_occurrence("collapsed-phrase-shape", F.array_join(text.collapse(F.col("words")), " "))] if collapsed else []
    rows += [_occurrence("num-word", F.size("words"))] if words else []
    shapes = F.transform("words", lambda w: _occurrence("word-shape", w))
    out = voting(e.select(*KEYS, F.inline(F.concat(F.array(*rows), shapes))), KEYS, "entity")
    most = e.groupBy(*KEYS, "e").agg(F.count("*").alias("c")).groupBy(*KEYS).agg(F.max("c").alias("c"), F.sum("c").alias("n"))
    names = _steps(F.lit("entity-max-duplication"), stats.quantized(F.col("c")))
    names = F.concat(names, _steps(F.lit("num-entities"), stats.quantized(F.col("n")))) if count else names
    out = out.unionByName(indicators(most, KEYS, "entity", names))
    if mean:
        # Inlined, as the condition on n would else be computed from the string once more for each use of its shape.
        per = stats.mean_dev(e.select(*KEYS, F.inline(F.array(F.struct(F.size("words").alias("n"))))), KEYS, "n")
        if steps:
            out = out.unionByName(indicators(per, KEYS, "entity", F.concat(*(_steps(F.lit(f"num-word-{k}"), stats.quantized(F.col(k))) for k in ("mean", "deviation")))))
        else:
            out = out.unionByName(per.select(*KEYS, F.inline(F.array(*(F.struct(F.lit(f"entity :: num-word-{k}").alias("feature"), F.col(k).alias("value")) for k in ("mean", "deviation"))))))
    return out


def conjoin(features: DataFrame, query_type: str, pattern: str = "^(ling|entity).*", keep: bool = False, only: str | None = None, scale: float = 1.0) -> DataFrame:
    """Features that match ``pattern`` are made specific to the row's query type (a missing one is "null"); others apply to all.

    With ``only`` a type is just I, that one, or O, any other. ``keep`` keeps the features as they were too; ``scale`` multiplies the values of the new ones.
    """
    own = F.coalesce(F.col(query_type), F.lit("null"))
    own = own if only is None else F.when(own == only, "I").otherwise("O")
    to = F.when(F.col("feature").rlike(pattern), own).otherwise("ALL")
    named = F.struct(F.concat(to, F.lit(" "), "feature").alias("f"), F.lit(float(scale)).alias("k"))
    rows = features.withColumn("_x", F.explode(F.array(named, *([F.struct(F.col("feature").alias("f"), F.lit(1.0).alias("k"))] if keep else []))))
    rows = rows.withColumn("feature", F.col("_x.f"))
    return (rows.withColumn("value", F.col("value") * F.col("_x.k")) if "value" in features.columns else rows).drop("_x")


def common(features: DataFrame, example: list[str], least: int = 2) -> DataFrame:
    """Features that at least ``least`` examples have."""
    often = features.select(*example, "feature").distinct().groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("feature")
    return features.join(often, "feature", "left_semi")
