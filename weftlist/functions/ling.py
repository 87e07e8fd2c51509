"""Annotated phrases: arrays of (token, lemma, pos, pos_type, ner, ner_value), and what is read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.functions import text

# Auxiliary verbs, and tags of open word classes.
AUXILIARIES = (
    "is", "are", "was", "were", "am", "be", "been", "will", "shall", "have", "has", "had", "would", "could", "should",
    "do", "does", "did", "can", "may", "might", "must", "seem",
)
OPEN_TAGS = ("CD", "FW", "JJ", "JJR", "JJS", "NN", "NNP", "NNPS", "NNS", "RB", "RBR", "RBS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
TOKENS = "array<struct<token:string,lemma:string,pos:string,pos_type:string,ner:string,ner_value:string>>"


def pos_type(pos: Column, word: Column) -> Column:
    """AUX for auxiliary verbs, OPEN for nouns, verbs, adjectives, adverbs and numbers, else CLOSE."""
    aux = F.lower(word).isin(*AUXILIARIES) & F.startswith(pos, F.lit("V"))
    return F.when(aux, "AUX").when(pos.isin(*OPEN_TAGS), "OPEN").otherwise("CLOSE")


def crude(phrase: Column) -> Column:
    """Tokens of a phrase split at white space: numbers are CD and NUMBER, others UNK and UNK, all of an open class. An empty phrase has one empty token."""
    number = lambda w: w.rlike(r"^[\x00-\x20]*[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?)[\x00-\x20]*$")
    words = text.java_split(F.regexp_replace(text.trim(phrase), r"[ \t\n\x0B\f\r]+", " "), " ")
    return F.transform(words, lambda w: F.struct(
        w.alias("token"), w.alias("lemma"), F.when(number(w), "CD").otherwise("UNK").alias("pos"), F.lit("OPEN").alias("pos_type"),
        F.when(number(w), "NUMBER").otherwise("UNK").alias("ner"), F.when(number(w), w).otherwise("UNK").alias("ner_value"),
    ))


def prepared(phrase: Column) -> Column:
    """A phrase as an annotator takes it: a hyphen before a letter is a blank."""
    return F.regexp_replace(phrase, "-(?=[a-zA-Z])", " ")


def annotated(df: DataFrame, phrase: str, cache: DataFrame | None = None, annotator: Callable[[Column], Column] = crude) -> DataFrame:
    """``df`` with ``tokens``: those of ``cache`` (phrase, tokens) where it has the phrase, else the annotator's."""
    if cache is None:
        return df.withColumn("tokens", annotator(F.col(phrase)))
    known = cache.select(F.col("phrase").alias(phrase), F.col("tokens").alias("_known"))
    return df.join(known, phrase, "left").withColumn("tokens", F.coalesce("_known", annotator(F.col(phrase)))).drop("_known")


def missing(df: DataFrame, phrase: str, cache: DataFrame, annotator: Callable[[Column], Column] = crude) -> DataFrame:
    """(phrase, tokens) of the phrases that ``cache`` lacks, each once: what a cache is to be extended by."""
    new = df.select(F.col(phrase).alias("phrase")).where("phrase is not null").distinct().join(cache, "phrase", "left_anti")
    return new.withColumn("tokens", annotator(F.col("phrase")))


def tags(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t.pos)


def token_set(tokens: Column, lemmas: bool = False, only_open: bool = False) -> Column:
    """The distinct tokens or lemmas, of open classes only if wished."""
    kept = F.filter(tokens, lambda t: t.pos_type == "OPEN") if only_open else tokens
    return F.array_distinct(F.transform(kept, lambda t: t.lemma if lemmas else t.token))


def phrase_of(tokens: Column, start: Column, end: Column, lemmas: bool = False) -> Column:
    """The tokens of [start, end) joined; null for an empty range."""
    part = F.transform(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), lambda t: t.lemma if lemmas else t.token)
    return F.when(start < end, F.array_join(part, " "))


def last_noun(tokens: Column) -> Column:
    """Place of the last token whose tag begins with N, -1 if none does."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when(F.startswith(t.pos, F.lit("N")), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(places), F.lit(-1))


def word_at(tokens: Column, place: Column, lemmas: bool = True) -> Column:
    """The token at a place, an empty string where there is none."""
    found = F.when(place >= 0, F.get(tokens, place))
    return F.coalesce(found["lemma"] if lemmas else found["token"], F.lit(""))


def last_word(tokens: Column, lemmas: bool = True) -> Column:
    return word_at(tokens, F.size(tokens) - 1, lemmas)


def head_word(tokens: Column, hacked: Column, lemmas: bool = True) -> Column:
    """The head word: its place is found on the tokens of the rewritten phrase and read from those of the phrase itself."""
    place = text.head_index(tags(hacked), F.transform(hacked, lambda t: t.ner))
    return word_at(tokens, F.coalesce(place, F.lit(-1)), lemmas)


def ner_span(tokens: Column, tag: str, start: Column, end: Column) -> Column:
    """The normalised value shared by all of [start, end), if it has the tag and neither neighbour has the value; else null."""
    at = lambda i: F.get(tokens, i)
    value = at(start)["ner_value"]
    same = F.forall(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(1))), lambda t: t.ner_value == value)
    outside = (start > 0) & (at(start - 1)["ner_value"] == value) | (end < F.size(tokens)) & (at(end)["ner_value"] == value)
    return F.when((at(start)["ner"] == tag) & same & ~F.coalesce(outside, F.lit(False)), value)


def cluster_pair(a: Column, b: Column) -> Column:
    """Prefixes of two clusters side by side, by length."""
    return F.transform(F.array(*map(F.lit, (4, 6, 10, 20))), lambda n: F.concat(F.substring(a, F.lit(1), n), F.lit("|"), F.substring(b, F.lit(1), n)))


def smoothed(frequency: Column) -> Column:
    """A word's frequency plus 1; 1 for an unseen word."""
    return F.coalesce(frequency, F.lit(0)) + 1


def with_type(df: DataFrame, phrase: str, types: DataFrame) -> DataFrame:
    """``df`` with headword and query_type of ``types`` (query, headword, type); an unknown one has type "null"."""
    found = types.select(F.col("query").alias(phrase), "headword", F.col("type").alias("query_type")).dropDuplicates([phrase])
    return df.join(found, phrase, "left").withColumn("query_type", F.coalesce("query_type", F.lit("null")))


def cluster_shape(df: DataFrame, key: list[str], phrase: str, clusters: DataFrame) -> DataFrame:
    """(key, repn): each word of a phrase as its cluster (word, cluster), else its shape; EMPTY for an empty phrase. Commas, ! and : are words."""
    spaced = F.regexp_replace(phrase, "([,!:])", " $1 ")
    words = df.select(*key, F.col(phrase).alias("phrase"), F.posexplode_outer(F.filter(F.split(spaced, " "), lambda w: w != "")).alias("i", "word"))
    named = words.join(clusters.select("word", "cluster"), "word", "left").withColumn("c", F.coalesce("cluster", text.phrase_shape(F.col("word"))))
    out = named.groupBy(*key).agg(F.first("phrase").alias("phrase"), F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("i", "c")))).alias("parts"))
    return out.select(*key, F.when(F.col("phrase") == "", "EMPTY").otherwise(F.array_join(F.transform("parts", lambda p: p.c), " ")).alias("repn"))


def sha1_number(c: Column) -> Column:
    """SHA-1 as a hexadecimal number, without leading zeros; zero is 0."""
    return F.regexp_replace(F.sha1(c.cast("binary")), "^0+(?=.)", "")
