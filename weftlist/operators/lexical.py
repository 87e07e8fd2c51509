"""Features from words: tokens and their tags, clusters, frequencies, headers, and pooled word vectors.

Groups are (page_id, root_no, group_id, node_ids, entities), phrases (page_id, phrase) and clusters (word, cluster).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.functions import ling, stats, text
from weftlist.operators.features import KEYS, _occurrence, _steps, bag, entropy_features, indicators, levels, voting

# Words that lists of entities seldom hold.
BAD_WORDS = (
    "com", "new", "about", "my", "home", "search", "information", "view", "page", "site", "click", "http", "contact", "www", "ord",
    "free", "now", "subscribe", "see", "service", "services", "online", "re", "data", "email", "top", "find", "system", "support",
    "comments", "policy", "last", "privacy", "post", "date", "time", "print",
)


def token_freq(groups: DataFrame, ranks: DataFrame | None = None, tops: tuple[int, ...] = (30, 300, 3000)) -> DataFrame:
    """Shares of listed words, of digits, and of the most frequent words by ``ranks`` (word, rank from 1), among the words of a group."""
    words = groups.select(*KEYS, F.explode("entities").alias("e")).select(*KEYS, F.explode(text.alnum_tokens(F.col("e"))).alias("word"))
    words = words.withColumn("rank", F.lit(None).cast("int")) if ranks is None else words.join(ranks.select("word", "rank"), "word", "left")
    counts = [F.count_if(F.col("word").isin(*BAD_WORDS)).alias("bad"), F.count_if(F.col("word").rlike("^[0-9]+$")).alias("digits"), *[F.count_if(F.col("rank") <= t).alias(f"top{t}") for t in tops]]
    per = words.groupBy(*KEYS).agg(F.count("*").alias("n"), *counts)
    share = lambda name, c: _steps(F.lit(name), stats.percents(F.col(c) / F.col("n")), "%")
    names = [share("bad-words-ratio", "bad"), share("digits-ratio", "digits")]
    names += [F.when(F.col(f"top{t}") > 0, share(f"frequent-{t}", f"top{t}")).otherwise(F.array().cast("array<string>")) for t in tops]
    return indicators(per, KEYS, "token-freq", F.concat(*names))


def tokens_of(groups: DataFrame, cache: DataFrame | None = None, annotator: Callable[[Column], Column] = ling.crude) -> DataFrame:
    """(keys, e, tokens) of every string of every group."""
    return ling.annotated(groups.select(*KEYS, F.explode("entities").alias("e")), "e", cache, annotator).where(F.size("tokens") > 0)


def linguistic(groups: DataFrame, cache: DataFrame | None = None, annotator: Callable[[Column], Column] = ling.crude, lemmas: bool = False, steps: bool = True, collapsed: bool = True, whole: bool = False, votes: bool = False) -> DataFrame:
    """Entropy and shares of the words' tags, votes on the strings' tags without repeats, entropy of first and last words.

    ``steps=False`` only names the tags there are; ``whole`` votes on the strings' tags as they are, ``votes`` on the words' tags.
    """
    e = tokens_of(groups, cache, annotator)
    word = lambda t: t["lemma"] if lemmas else t["token"]
    every = ling.tags(F.col("tokens"))
    rows = [_occurrence("first-token", word(F.get("tokens", F.lit(0))), only_entropy=True), _occurrence("last-token", word(F.element_at("tokens", -1)), only_entropy=True)]
    rows += [_occurrence("entity-collapsed-pos", F.array_join(text.collapse(every), " "))] if collapsed else []
    rows += [_occurrence("entity-pos", F.array_join(every, " "))] if whole else []
    tags = e.select(*KEYS, F.explode(every).alias("pos"))
    of_words = tags.select(*KEYS, F.inline(F.array(_occurrence("word-pos", F.col("pos"), only_entropy=True), *([_occurrence("word-pos", F.col("pos"))] if votes else []))))
    out = voting(e.select(*KEYS, F.inline(F.array(*rows))).unionByName(of_words), KEYS, "ling")
    counts = tags.groupBy(*KEYS, "pos").agg(F.count("*").alias("c"))
    shares = counts.join(tags.groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS)
    name = F.concat(F.lit("word-pos = "), "pos")
    return out.unionByName(indicators(shares, KEYS, "ling", _steps(name, stats.percents(F.col("c") / F.col("n")), "%") if steps else F.array(name)))


def cluster(groups: DataFrame, phrases: DataFrame, clusters: DataFrame, cache: DataFrame | None = None, annotator: Callable[[Column], Column] = ling.crude) -> DataFrame:
    """Each word or cluster prefix of the phrase with each cluster prefix of the group's strings, and with the entropy of their clusters."""
    asked = ling.annotated(phrases, "phrase", cache, annotator).select("page_id", F.explode(ling.token_set(F.col("tokens"), True, True)).alias("word")).join(clusters, "word", "left")
    asked = asked.select("page_id", F.explode(F.concat(F.array("word"), F.coalesce(text.cluster_prefixes(F.col("cluster")), F.array().cast("array<string>")))).alias("q")).distinct()
    found = tokens_of(groups, cache, annotator).select(*KEYS, F.explode("tokens").alias("t")).select(*KEYS, F.col("t.token").alias("word")).join(clusters, "word")
    prefixes = found.select(*KEYS, F.explode(text.cluster_prefixes(F.col("cluster"))).alias("p")).distinct()
    pairs = prefixes.join(asked, "page_id").select(*KEYS, F.concat(F.lit("cluster :: query = "), "q", F.lit(" | entity ~ "), "p").alias("feature"), F.lit(1.0).alias("value"))
    spread = groups.select(*KEYS).distinct().join(stats.multiset(found, KEYS, "cluster").select(*KEYS, "normalized_entropy"), KEYS, "left").join(asked, "page_id")
    spread = spread.select(*KEYS, F.concat(F.lit("cluster :: query = "), "q", F.lit(" | entity-normalized-entropy")).alias("feature"), F.coalesce("normalized_entropy", F.lit(0.0)).alias("value"))
    return pairs.unionByName(spread)


def headers(nodes: DataFrame, groups: DataFrame, depth: int = 5) -> DataFrame:
    """(keys, header): texts at the top hole of each level, in the place that matches the selected nodes'."""
    n = levels(nodes, groups, depth).where("depth > 2")
    per = n.groupBy(*KEYS, "level", "parent_id").agg(F.count("*").alias("n"), F.min("child_idx").alias("low"), F.min("pre_id").alias("first"))
    one = F.when(F.col("n") == 1, F.col("low")).otherwise(-1)
    level = per.groupBy(*KEYS, "level").agg(F.bool_or(F.col("low") > 0).alias("top"), F.when(F.min(one) == F.max(one), F.min(one)).otherwise(-1).alias("idx"), F.min_by("parent_id", "first").alias("at"))
    stack = level.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "idx"))), lambda x: x["idx"]).alias("stack"))
    at = level.where("top").join(stack, KEYS).select(*KEYS, "level", "at", F.expr("concat(array(0), reverse(slice(stack, 1, level)))").alias("way"), F.lit(True).alias("on"))
    kids = nodes.select("page_id", "root_no", F.col("parent_id").alias("at"), F.col("child_idx").alias("step"), F.col("pre_id").alias("next"))
    for i in range(depth):
        at = at.withColumn("step", F.when(F.col("on"), F.get("way", F.lit(i)))).join(kids, ["page_id", "root_no", "at", "step"], "left")
        at = at.withColumn("at", F.coalesce("next", "at")).withColumn("on", F.col("next").isNotNull()).drop("step", "next")
    texts = nodes.select("page_id", "root_no", F.col("pre_id").alias("at"), F.col("full_text").alias("header"))
    return at.join(texts, ["page_id", "root_no", "at"]).where("header <> ''").select(*KEYS, "header")


def header(nodes: DataFrame, groups: DataFrame, heads: DataFrame, prefixes: tuple[int, ...] = (), clusters: DataFrame | None = None, binary: bool = False, cache: DataFrame | None = None, annotator: Callable[[Column], Column] = ling.crude) -> DataFrame:
    """Whether headers have the phrase's head word, from ``heads`` (page_id, headword), and their words (prefix 0) or cluster prefixes of given lengths."""
    h = headers(nodes, groups)
    h = ling.annotated(h.distinct() if binary else h, "header", cache, annotator)
    match = h.join(heads, "page_id").where(F.exists("tokens", lambda t: t.lemma == F.lower("headword"))).select(*KEYS, F.lit("header :: match-headword").alias("feature"), F.lit(1.0).alias("value"))
    words = h.select(*KEYS, F.explode("tokens").alias("t")).select(*KEYS, F.col("t.token").alias("word"), F.lower("t.lemma").alias("lemma"))
    out = match
    for length in prefixes:
        if length == 0:
            out = out.unionByName(indicators(words.where(F.col("lemma").rlike("^[a-z]+$")), KEYS, "header", F.array(F.concat(F.lit("header ~ "), "lemma"))))
        elif clusters is not None:
            out = out.unionByName(indicators(words.join(clusters, "word"), KEYS, "header", F.array(F.concat(F.lit("header ~ "), F.substring("cluster", 1, length)))))
    return bag(out, KEYS)


def lemma_names(name: str, tokens: Column, only_open: bool = False, pairs: bool = False) -> Column:
    """Feature names of a phrase's lemmas or, with ``pairs``, of all pairs of them, SAME for each pair of equals."""
    own = ling.token_set(tokens, True, only_open)
    if not pairs:
        return F.transform(own, lambda a: F.concat(F.lit(f"{name}-lemma ~ "), a))
    both = lambda a, b: F.array_compact(F.array(F.concat(F.lit(f"{name}-lemma ~ "), a, F.lit("|"), b), F.when(a == b, F.lit(f"{name}-lemma SAME"))))
    return F.flatten(F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: both(a, b)))))


def cluster_names(name: str, clusters: Column, other: Column | None = None) -> Column:
    """Feature names of clusters and their prefixes, or of all pairs with ``other``."""
    if other is None:
        one = lambda c: F.concat(F.array(F.concat(F.lit(f"{name}-cluster = "), c)), F.transform(text.cluster_prefixes(c), lambda p: F.concat(F.lit(f"{name}-cluster ~ "), p)))
        return F.flatten(F.transform(F.array_compact(clusters), one))
    two = lambda a, b: F.concat(F.array(F.concat(F.lit(f"{name}-cluster = "), a, F.lit("|"), b)), F.transform(ling.cluster_pair(a, b), lambda p: F.concat(F.lit(f"{name}-cluster ~ "), p)))
    return F.flatten(F.flatten(F.transform(F.array_compact(clusters), lambda a: F.transform(F.array_compact(other), lambda b: two(a, b)))))


def node_names(name: str, tag: Column, attrs: Column, words: bool = False) -> Column:
    """Feature names of a node's tag, id and classes: with digit runs as 0, or as words."""
    def part(key: str, split: bool) -> Column:
        value = F.nullif(attrs[key], F.lit(""))
        if words:
            return F.transform(text.bag_of_words(value), lambda w: F.concat(F.lit(f"{name}-{key} ~ "), w))
        values = text.java_split(value, r"[ \t\n\x0B\f\r]+") if split else F.array(value)
        return F.transform(values, lambda v: F.concat(F.lit(f"{name}-{key} = "), F.regexp_replace(v, "[0-9]+", "0")))

    none = F.array().cast("array<string>")
    return F.concat(F.array(F.concat(F.lit(f"{name}-tag = "), tag)), F.when(attrs["id"] != "", part("id", False)).otherwise(none), F.when(attrs["class"] != "", part("class", True)).otherwise(none))


def distinct_names(df: DataFrame, keys: list[str], domain: str, name: str, value: str, words: bool = False) -> DataFrame:
    """A feature for each different value of a key, or for each of its words."""
    each = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("v")).distinct()
    names = F.transform(text.bag_of_words(F.col("v")), lambda w: F.concat(F.lit(f"{name} ~ "), w)) if words else F.array(F.concat(F.lit(f"{name} = "), "v"))
    return indicators(each, keys, domain, names)


def word_pairs(name: str, a: Column, b: Column) -> Column:
    """Feature names of each word of one string with each of another."""
    return F.flatten(F.transform(text.bag_of_words(a), lambda x: F.transform(text.bag_of_words(b), lambda y: F.concat(F.lit(f"{name} ~ "), x, F.lit("|"), y))))


def cut_range_names(xpath: Column, start: Column, end: Column) -> Column:
    """Feature names of a list cut at its start or end, each also with its path's last step."""
    last = F.element_at(F.split(xpath, "/"), -1)
    kinds = {"has-cut": start + end > 0, "cut-first-only": (start == 1) & (end == 0), "cut-last-only": (start == 0) & (end == 1), "cut-front": start > 0, "cut-back": end > 0}
    return F.flatten(F.array(*[F.when(c, F.array(F.lit(k), F.concat(F.lit(f"{k} | tag = "), last))).otherwise(F.array().cast("array<string>")) for k, c in kinds.items()]))


def pooled(words: DataFrame, key: list[str], vectors: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(key, averaged, freq_weighted, open_pos, freq_weighted_open_pos, least, most) of words (key, place, word, pos_type).

    Averages of the known words' ``vectors`` (word, vector): plain, each divided by its frequency plus one (word, frequency),
    of open classes, and both; null without any word. ``least`` and ``most`` are the first word's vector, as plain averaging leaves them.
    """
    w = words.join(vectors, "word")
    w = w.withColumn("frequency", F.lit(None).cast("long")) if frequencies is None else w.join(frequencies.select("word", "frequency"), "word", "left")
    w = w.withColumn("f", 1.0 / ling.smoothed(F.col("frequency"))).withColumn("o", (F.col("pos_type") == "OPEN").cast("double"))
    kinds = {"averaged": F.lit(1.0), "freq_weighted": F.col("f"), "open_pos": F.col("o"), "freq_weighted_open_pos": F.col("f") * F.col("o")}
    sums = w.groupBy(*key).agg(*[F.sum(k).alias(f"{n}_all") for n, k in kinds.items()], F.min_by("vector", "place").alias("least"))
    dims = w.select(*key, "f", "o", F.posexplode("vector").alias("i", "x")).groupBy(*key, "i").agg(*[F.sum(F.col("x") * k).alias(n) for n, k in kinds.items()])
    rows = dims.groupBy(*key).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(n).alias("x")))), lambda s: s.x).alias(f"{n}_sum") for n in kinds])
    out = rows.join(sums, key)
    mean = lambda n: F.when(F.col(f"{n}_all") >= 1e-6, F.transform(f"{n}_sum", lambda x: x / F.col(f"{n}_all"))).alias(n)
    return out.select(*key, *[mean(n) for n in kinds], "least", F.col("least").alias("most"))


def termwise(df: DataFrame, key: list[str], domain: str, name: str, vector: str, factor: Column | None = None) -> DataFrame:
    """A feature for each dimension of a vector, or of its product with another."""
    v = F.col(vector) if factor is None else F.zip_with(vector, factor, lambda a, b: a * b)
    rows = df.select(*key, F.posexplode(v).alias("i", "value"))
    return rows.select(*key, F.concat(F.lit(f"{domain} :: {name}["), F.col("i").cast("string"), F.lit("]")).alias("feature"), "value")


def outer(df: DataFrame, key: list[str], x: str, y: str, domain: str = "fake-wordvec", before: str = "", between: str = "") -> DataFrame:
    """A feature for each pair of dimensions of two vectors; none where one is null."""
    rows = df.select(*key, F.posexplode(x).alias("i", "a"), y).select(*key, "i", "a", F.posexplode(y).alias("j", "b"))
    return rows.select(*key, F.concat(F.lit(f"{domain} :: {before}["), F.col("i").cast("string"), F.lit(f"]{between}["), F.col("j").cast("string"), F.lit("]")).alias("feature"), (F.col("a") * F.col("b")).alias("value"))
