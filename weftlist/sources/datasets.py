"""Datasets, cached pages, lookup tables, word vectors and model files."""

from __future__ import annotations

import itertools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATASET = """options struct<cacheDirectory: string, useHashcode: boolean, detailed: boolean>,
data array<struct<hashcode: string, query: string, url: string, entities: array<string>,
rawanswers: array<struct<type: string, answers: array<string>>>, criteria: struct<first: string, second: string, last: string>>>"""
EXAMPLE = ["ex_id", "hashcode", "phrase", "url", "entities", "first", "second", "last", "detailed", "cache_directory"]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row for each datum of a JSON dataset, in the file's order; unknown keys are ignored."""
    rows = spark.read.schema(DATASET).option("multiLine", True).json(path).select("options", F.posexplode("data").alias("ex_id", "d"))
    return rows.select("ex_id", "d.hashcode", F.col("d.query").alias("phrase"), "d.url", "d.entities", "d.criteria.first", "d.criteria.second", "d.criteria.last", F.coalesce("options.detailed", F.lit(False)).alias("detailed"), F.col("options.cacheDirectory").alias("cache_directory"))


def fraction_split(examples: DataFrame, train: float = 1.0, test: float = 0.0, seed: int | None = None) -> DataFrame:
    """A row of each split an example belongs to: the first part trains and the last tests; they may overlap or leave a gap. With a seed their order is shuffled first.

    Shares are taken as the decimals they are written as: 0.7 of 90,000 is 63,000, where binary fractions fall just short of it.
    """
    n = examples.agg(F.count("*").alias("n")).first().n
    if seed is not None:
        places = examples.sparkSession.createDataFrame([(old, new) for new, old in enumerate(java_shuffle(n, seed))], "ex_id long, _new long")
        examples = examples.join(places, "ex_id").withColumn("ex_id", F.col("_new")).drop("_new")
    first, last = int(n * Decimal(str(train))), int(n * (1 - Decimal(str(test))))
    split = F.array(F.when(F.col("ex_id") < first, F.lit("train")), F.when(F.col("ex_id") >= last, F.lit("test")))
    return examples.withColumn("split", F.explode(F.filter(split, lambda s: s.isNotNull())))


def java_shuffle(n: int, seed: int = 42) -> list[int]:
    """Which element stands at each place after the standard shuffle with the 48-bit linear congruential generator."""
    state, order = (seed ^ 0x5DEECE66D) & (2**48 - 1), list(range(n))

    def bits(k: int) -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & (2**48 - 1)
        x = state >> (48 - k)
        return x - 2**k if x >= 2 ** (k - 1) and k == 32 else x

    def below(bound: int) -> int:
        if bound & -bound == bound:
            return (bound * bits(31)) >> 31
        while True:
            x = bits(31)
            if x - x % bound + bound - 1 < 2**31:
                return x % bound

    for i in range(n, 1, -1):
        j = below(i)
        order[i - 1], order[j] = order[j], order[i - 1]
    return order


def reshuffled(examples: DataFrame, times: int = 1, train: float | None = None, seed: int = 42) -> DataFrame:
    """Examples with a new ``split`` after shuffling training and then test ones ``times`` times, each time from the seed.

    The sizes stay, or the first ``train`` share trains. Only the numbering goes through the driver, 8 bytes for an example of a
    labelled data set; the rows are joined to it.
    """
    spark = examples.sparkSession
    w = Window.orderBy(F.col("split") != "train", "ex_id")  # data sets of questions, not pages
    numbered = examples.withColumn("_at", F.row_number().over(w) - 1)
    n, first = numbered.count(), numbered.where("split = 'train'").count()
    order = list(range(n))
    for _ in range(times):
        order = [order[i] for i in java_shuffle(n, seed)]
    limit = first if train is None else int(n * Decimal(str(train)))
    places = spark.createDataFrame([(old, new, "train" if new < limit else "test") for new, old in enumerate(order)], "_at long, place long, _split string")
    return numbered.join(places, "_at").withColumn("split", F.col("_split")).drop("_at", "_split")


def toy(spark: SparkSession, name: str = "all") -> DataFrame:
    """A few built-in questions and answers for tests: (ex_id, phrase, entities, split, dataset); "all" has the first set as its test part."""
    sets = {
        "colours": [("primary colours", ["red", "yellow", "blue"]), ("colours of the rainbow", ["red", "orange", "yellow", "green", "blue", "indigo", "violet"])],
        "planets": [("inner planets", ["Mercury", "Venus", "Earth", "Mars"]), ("gas giants", ["Jupiter", "Saturn", "Uranus", "Neptune"])],
        "days": [("weekend days", ["Saturday", "Sunday"]), ("working days", ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"])],
    }
    if name not in (*sets, "one", "all"):
        raise ValueError(f"no such data set: {name}")
    chosen = [("colours", *sets["colours"][0])] if name == "one" else [(k, *e) for k, v in sets.items() if name in (k, "all") for e in v]
    rows = [(i, p, e, "test" if name == "all" and k == "colours" else "train", k) for i, (k, p, e) in enumerate(chosen)]
    return spark.createDataFrame(rows, "ex_id long, phrase string, entities array<string>, split string, dataset string")


def load(spark: SparkSession, root: str, name: str, train: float = 1.0, test: float = 0.0) -> DataFrame:
    """Examples of "family.name"; "a@b" trains on all of a and tests on all of b, "a+b" keeps the splits of both."""
    family, dot, rest = name.partition(".")
    if not dot or "." in rest:
        raise ValueError(f"not a family and a name: {name}")
    if family == "unary":
        return toy(spark, rest)
    if "@" in rest:
        left, right = rest.split("@", 1)
        parts = [load(spark, root, f"{family}.{x}", train, test).drop("split").distinct().withColumn("split", F.lit(s)) for x, s in ((left, "train"), (right, "test"))]
    elif "+" in rest:
        parts = [load(spark, root, f"{family}.{x}", train, test) for x in rest.split("+")]
    else:
        return fraction_split(read_dataset(spark, f"{root}/{family}/{rest}.json"), train, test).withColumn("dataset", F.lit(rest))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cached_parts(content: Column) -> Column:
    """(url, timestamp, body, error) of a cached page: a comment line with the quoted address, then the page, or an error mark and its message."""
    failed = F.startswith(content, F.lit("ERROR"))
    lines = F.split(content, "\n", 3)
    head = F.when(failed, F.get(lines, F.lit(2))).otherwise(F.get(lines, F.lit(0)))
    mark = r"^<!-- (\S+) (.*) -->"
    return F.struct(F.url_decode(F.regexp_extract(head, mark, 1)).alias("url"), F.regexp_extract(head, mark, 2).alias("timestamp"), F.when(~failed, F.get(F.split(content, "\n", 2), F.lit(1))).alias("body"), F.when(failed, F.get(lines, F.lit(1))).alias("error"))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, url, timestamp, body, error) of the cached pages of a folder, whose file names are the addresses' SHA-1."""
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("hash"), F.decode("content", "UTF-8").alias("content"))
    return files.withColumn("p", cached_parts(F.col("content"))).select("hash", "p.*")


def page_address(examples: DataFrame, results: DataFrame | None = None, most: int = 1) -> DataFrame:
    """Examples with the address of their page: their own, a phrase that is one, else the first ``most`` results (query, rank, result_url)."""
    own = F.coalesce("url", F.when(F.startswith("phrase", F.lit("http://")), F.col("phrase")))
    out = examples.withColumn("url", own)
    if results is None:
        return out
    top = results.where(F.col("rank") <= most).select(F.col("query").alias("phrase"), "result_url")
    return out.where("url is not null").unionByName(out.where("url is null").join(top, "phrase", "left").withColumn("url", F.col("result_url")).drop("result_url"))


def source_of(examples: DataFrame) -> DataFrame:
    """Examples with ``kind`` and ``key`` of their page source: a cached page by hash, a cached one by address, an encyclopedia title, or a search for a list."""
    cached = F.col("cache_directory").isNotNull()
    kind = F.when(cached & F.col("hashcode").isNotNull(), "hash").when(cached & F.col("url").isNotNull(), "url").when(F.startswith("phrase", F.lit("wiki:")), "wiki").otherwise("search")
    title = F.regexp_replace(F.substring("phrase", 6, 2**30), " ", "_")
    key = F.when(F.col("kind") == "hash", F.col("hashcode")).when(F.col("kind") == "url", F.col("url")).when(F.col("kind") == "wiki", title).otherwise(F.concat(F.lit("list of "), "phrase"))
    return examples.withColumn("kind", kind).withColumn("key", key)


def read_search_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(query, rank, result_url, title) of cached search results: a file named by the quoted query with a JSON list of link and title."""
    files = spark.read.format("binaryFile").load(folder).select(F.url_decode(F.substring_index("path", "/", -1)).alias("name"), F.decode("content", "UTF-8").alias("content"))
    rows = files.select(F.url_decode("name").alias("query"), F.posexplode(F.from_json("content", "array<struct<link:string,title:string>>")).alias("i", "r"))
    return rows.select("query", (F.col("i") + 1).alias("rank"), F.col("r.link").alias("result_url"), "r.title")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, tokens) of a JSON-lines cache of annotated phrases, compressed or not."""
    return spark.read.schema("phrase string, tokens array<struct<token:string,lemma:string,pos:string,pos_type:string,ner:string,ner_value:string>>").json(path)


def write_annotations(cache: DataFrame, path: str) -> None:
    cache.select("phrase", "tokens").write.mode("append").option("compression", "gzip").json(path)


def word_ranks(table: DataFrame, order: str = "place") -> DataFrame:
    """(word, rank) of a table of words (word, place) by frequency, rank 1 first; of a repeated word the best."""
    return table.groupBy("word").agg((F.min(order) + 1).alias("rank"))


def variants(options: dict[str, list]) -> list[dict]:
    """Every choice of one value for each option, the last option changing fastest."""
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table of tab-separated values: query types, word clusters, frequencies."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file whose first line gives number and dimension."""
    words = F.split("value", " ")
    return spark.read.text(path).where(F.size(words) > 2).select(F.get(words, F.lit(0)).alias("word"), F.slice(words, 2, 2**30).cast("array<double>").alias("vector"))


def write_params(params: DataFrame, path: str) -> None:
    """Tab-separated features and weights, heaviest first."""
    params.select("feature", "weight").orderBy(F.desc("weight"), "feature").write.option("sep", "\t").option("quote", "").csv(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "feature string, weight double")


def blacklisted(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages whose address has no listed host (host)."""
    return pages.withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1)).join(hosts, "host", "left_anti").drop("host")
