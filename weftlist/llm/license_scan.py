"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

Paragraphs (lines of a text, and the words around each line end between two lines with words) are classified by multinomial logistic regression over word 2- and 3-grams into
licence families or ``unknown``. It is fitted on the driver to a bounded set: notices of each family with words dropped,
swapped and surrounded by others, and, for ``unknown``, shuffled notices and prose. The temperature of
the softmax is then set on further such paragraphs so that probabilities are calibrated. Scoring joins n-grams
with the weight table, whose size the notices bound. A prediction is confirmed by comparing the paragraph
with its family's notice: at least ``CONFIRM`` of the notice's distinct 2-grams must be in it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.tables import fence, keep, only_ids

# Short notices by which licences are declared.
NOTICES = {
    "agpl-3.0": ["this work is licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 license"],
    "cc0": ["to the extent possible under law the author has waived all copyright", "released under cc0 1.0 universal public domain dedication"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and/or modify it under the terms of the gnu general public license"],
    "lgpl-3.0": ["this work is licensed under the gnu lesser general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["this source code is subject to the terms of the mozilla public license version 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
FAMILIES = [*NOTICES, "unknown"]
CONFIRM = 0.6
#: Words taken on each side of a line end; more than any notice has.
AROUND = 24
#: Paragraphs made for each family to fit on.
EXAMPLES = 120
PROSE = "the of and to in is a that it as for was with on are by be this from at or an not but have they you which one all their has more if will about some than other into time only could new them man these then two first may any like now my such over our even most me made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long here get both between life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.+/-]*[a-z0-9+]", text.lower())


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def _examples(rng, count: int) -> tuple[list[set[str]], np.ndarray]:
    rows, labels = [], []
    for label, family in enumerate(FAMILIES):
        for k in range(count if family != "unknown" else count * 4):
            source = NOTICES[family if family != "unknown" else FAMILIES[rng.integers(len(NOTICES))]]
            words = words_of(source[k % len(source)])
            if family == "unknown":
                words = [words[i] for i in rng.permutation(len(words))] if k % 2 else list(rng.choice(PROSE, rng.integers(4, 30)))
            elif rng.random() < 0.5:
                at = rng.integers(len(words))
                words = words[:at] + ([] if rng.random() < 0.5 else [str(rng.choice(PROSE))]) + words[at + 1 :]
            around = list(rng.choice(PROSE, rng.integers(0, 12))), list(rng.choice(PROSE, rng.integers(0, 12)))
            rows.append(_grams(around[0] + words + around[1]))
            labels.append(label)
    return rows, np.array(labels)


def train(seed: int = 5, rounds: int = 300) -> dict[str, list[float]]:
    """gram -> weights by family; '' holds the biases. Grams of the notices only, so the table's size is fixed."""
    rng = np.random.default_rng(seed)
    known = sorted({g for texts in NOTICES.values() for t in texts for g in _grams(words_of(t))})
    place = {g: i for i, g in enumerate(known)}

    def matrix(rows):
        x = np.zeros((len(rows), len(known) + 1))
        x[:, -1] = 1
        for i, row in enumerate(rows):
            x[i, [place[g] for g in row if g in place]] = 1
        return x

    rows, y = _examples(rng, EXAMPLES)
    x, w = matrix(rows), np.zeros((len(known) + 1, len(FAMILIES)))
    goal = np.eye(len(FAMILIES))[y]
    square = np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (goal - p / p.sum(1, keepdims=True)) / len(y) - 1e-4 * w
        square += g * g
        w += 0.5 * g / np.sqrt(square)
    rows, y = _examples(rng, EXAMPLES // 2)
    z = matrix(rows) @ w
    losses = []
    scales = np.linspace(0.3, 3, 28)
    for scale in scales:
        s = z * scale
        s -= s.max(1, keepdims=True)
        losses.append(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())
    w *= scales[int(np.argmin(losses))]
    return {**{g: w[i].tolist() for g, i in place.items()}, "": w[-1].tolist()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_notices, families, notices) of every row.

    notices: (line from 0, family, probability, overlap, confirmed) of the lines whose likeliest class isn't
    ``unknown``, and of the line ends (by the line before) that a confirmed notice runs over: it overlaps more than either
    side alone does. A notice over several line ends is given once, at the first; none is given beside a line that
    is confirmed for the family by itself. A line without words ends a paragraph. families: the distinct confirmed ones in order of name. A line without any gram of a notice is unknown.
    Null and empty texts have none. Rows that repeat an id and text are rows of their own with equal results.
    """
    spark = docs.sparkSession
    weights = train()
    bias = weights.pop("")
    own = {}
    for f, texts in NOTICES.items():
        for v, t in enumerate(texts):
            for g in {g for g in _grams(words_of(t)) if g.count(" ") == 1}:
                own.setdefault(g, []).append(f"{f}:{v}")
    total = {f"{f}:{v}": len({g for g in _grams(words_of(t)) if g.count(" ") == 1}) for f, texts in NOTICES.items() for v, t in enumerate(texts)}
    quote = lambda s: "'" + s.replace("'", "\\'") + "'"
    body = ", ".join(f"({quote(g)}, array({', '.join(f'{x!r}D' for x in w)}), array({', '.join(map(quote, own[g])) if g in own else ''}))" for g, w in weights.items())
    table = spark.sql(f"select xxhash64(g) as g, w, cast(o as array<string>) as o from values {body} as t(g, w, o)")

    table = F.broadcast(table)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    split = "transform(split(lower(text), '\\n', -1), x -> regexp_extract_all(x, '[a-z0-9.+/-]*[a-z0-9+]', 0))"
    texts = fence(rows.where("text is not null"), "_ls", split).drop("text")
    lines = texts.select("doc_id", "th", F.posexplode("_ls").alias("line", "t")).select("doc_id", "th", "line", F.lit(False).alias("wrapped"), "t", F.size("t").alias("n"))
    side = lambda k: f"if(i + {k} < n, 0, if(i >= n, 1, 2)) as side"
    pairs = f"transform(sequence(0, size(t) - 2), i -> struct(xxhash64(concat(t[i], ' ', t[i + 1])) as g, {side(1)}))"
    threes = f"transform(sequence(0, size(t) - 3), i -> struct(xxhash64(concat(t[i], ' ', t[i + 1], ' ', t[i + 2])) as g, {side(2)}))"

    def matched(units: DataFrame) -> DataFrame:
        """The notices' n-grams in each unit, and whether they stand before and behind the line end in it."""
        unit = fence(units.withColumnRenamed("t", "_t"), "t", F.col("_t")).drop("_t").where("size(t) > 1")
        grams = unit.select("doc_id", "th", "line", "wrapped", F.explode(F.expr(f"concat({pairs}, if(size(t) < 3, cast(array() as array<struct<g:bigint,side:int>>), {threes}))")).alias("x"))
        hits = grams.select("doc_id", "th", "line", "wrapped", "x.g", "x.side").join(table.select("g"), "g")
        return hits.groupBy("doc_id", "th", "line", "wrapped", "g").agg(F.max(F.col("side") == 0).alias("in_before"), F.max(F.col("side") == 1).alias("in_after"))

    own_lines = keep(matched(lines), "lines")
    # A notice that runs over line ends can only be in a text that has enough of its 2-grams, those over a line end included.
    across = texts.where("size(_ls) > 1").select("doc_id", "th", F.explode(F.expr("transform(sequence(0, size(_ls) - 2), i -> if(size(_ls[i]) > 0 and size(_ls[i + 1]) > 0, xxhash64(concat(element_at(_ls[i], -1), ' ', _ls[i + 1][0])), null))")).alias("g"))
    grams_of = own_lines.select("doc_id", "th", "g").unionAll(across.join(table.select("g"), "g").select("doc_id", "th", "g")).distinct()
    share = grams_of.join(table, "g").select("doc_id", "th", F.explode("o").alias("notice")).groupBy("doc_id", "th", "notice").agg(F.count("*").alias("c"))
    sizes = spark.sql("select * from values " + ", ".join(f"({quote(k)}, {v})" for k, v in total.items()) + " as t(notice, size)")
    likely = share.join(F.broadcast(sizes), "notice").where(f"c / size >= {CONFIRM}").select("th").distinct()
    texts = fence(only_ids(rows.where("text is not null"), keep(likely, "likely"), "th"), "_ls", split).drop("text")
    # A line without words is a mark of its own, at which the words around a line end are cut off.
    marked = fence(texts.where("size(_ls) > 1"), "_m", "transform(_ls, x -> if(size(x) = 0, array('\\n'), x))").drop("_ls")
    ends = "filter(sequence(0, size(_m) - 2), i -> _m[i][0] <> '\\n' and _m[i + 1][0] <> '\\n')"
    near = f"transform({ends}, i -> struct(i as line, slice(reverse(flatten(slice(_m, greatest(i + 2 - {AROUND}, 1), least(i + 1, {AROUND})))), 1, {AROUND}) as b, slice(flatten(slice(_m, i + 2, {AROUND})), 1, {AROUND}) as a))"
    around = marked.select("doc_id", "th", F.explode(F.expr(near)).alias("x")).select("doc_id", "th", "x.line", "x.b", "x.a")
    upto = lambda c: f"if(array_position({c}, '\\n') > 0, slice({c}, 1, cast(array_position({c}, '\\n') - 1 as int)), {c})"
    around = around.select("doc_id", "th", "line", F.expr(f"reverse({upto('b')})").alias("b"), F.expr(upto("a")).alias("a"))
    around = around.select("doc_id", "th", "line", F.lit(True).alias("wrapped"), F.concat("b", "a").alias("t"), F.size("b").alias("n"))
    seen = own_lines.unionByName(matched(around)).join(table, "g")
    sums = seen.groupBy("doc_id", "th", "line", "wrapped").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(FAMILIES))], F.flatten(F.collect_list("o")).alias("o"), F.flatten(F.collect_list(F.when(F.col("in_before"), F.col("o")))).alias("before"), F.flatten(F.collect_list(F.when(F.col("in_after"), F.col("o")))).alias("after"))
    sums = sums.withColumn("z", F.array(*[F.col(f"z{i}") + bias[i] for i in range(len(FAMILIES))])).withColumn("top", F.array_max("z"))
    sums = sums.withColumn("label", F.expr("cast(array_position(z, top) - 1 as int)")).withColumn("probability", F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - top))"))
    names = "array(" + ", ".join(map(quote, FAMILIES)) + ")"
    totals = "map(" + ", ".join(f"{quote(k)}, {v}" for k, v in total.items()) + ")"
    sums = sums.where(f"label <> {len(FAMILIES) - 1}").withColumn("family", F.expr(f"{names}[label]"))
    share = lambda c: f"array_max(transform(filter(map_keys({totals}), k -> startswith(k, concat(family, ':'))), k -> size(filter({c}, x -> x = k)) / {totals}[k]))"
    found = sums.withColumn("overlap", F.expr(share("o"))).withColumn("confirmed", F.expr(f"overlap >= {CONFIRM}"))
    found = found.where(f"not wrapped or (confirmed and overlap > greatest({share('before')}, {share('after')}))")
    per = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("line", "family", "probability", "overlap", "confirmed", "wrapped"))).alias("all"))
    beside = "exists(all, y -> y.confirmed and y.family = x.family and ((y.wrapped and y.line = x.line - 1) or (not y.wrapped and y.line - x.line in (0, 1))))"
    per = per.select("doc_id", "th", F.expr(f"transform(filter(all, x -> not x.wrapped or not {beside}), x -> struct(x.line as line, x.family as family, x.probability as probability, x.overlap as overlap, x.confirmed as confirmed))").alias("notices"))
    per = per.withColumnsRenamed({"doc_id": "own_id", "th": "own_th"})
    out = rows.drop("text").join(per, F.expr("doc_id <=> own_id and th = own_th"), "left").select("doc_id", "notices")
    out = out.withColumn("notices", F.coalesce("notices", F.expr("cast(array() as array<struct<line:int,family:string,probability:double,overlap:double,confirmed:boolean>>)")))
    return out.select("doc_id", F.size("notices").alias("n_notices"), F.expr("array_sort(array_distinct(transform(filter(notices, x -> x.confirmed), x -> x.family)))").alias("families"), "notices")
