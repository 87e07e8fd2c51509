"""All queries of the page-list engine, by name, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlist.functions import ling, stats, text
from weftlist.operators import evaluation, features, learning, pages, ranking
from weftlist.sources import datasets, html

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftlist-")
    return f"{folder.rstrip('/')}/weftlist-{os.urandom(8).hex()}"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = r"regexp_replace(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"SELECT doc_id, {WS.format('text')} AS norm FROM documents")
def ws_normalize(s, d):
    return table(s, d, "documents").select("doc_id", text.ws_normalize(F.col("text")).alias("norm"))


# Part names with what the normalisers look at; the same text is read by both engines.
MARKED = """CASE p_partkey % 14 WHEN 0 THEN concat('‚„·…', p_name, 'ˆ˜‹›') WHEN 1 THEN concat('‘', p_name, '’´` “x” «y»') WHEN 2 THEN concat('• ', p_name, '†‡ a‐b‑c–d—e‒f―g‛') WHEN 3 THEN concat(p_name, '漢字 ok')
WHEN 4 THEN concat(p_name, '[12][nb 3][nb4][note]') WHEN 5 THEN concat(p_name, '***') WHEN 6 THEN concat(p_name, ' (1969) (1969 - 1972) (3) () (12-)') WHEN 7 THEN concat('"', p_name, '"') WHEN 8 THEN concat('12. ', p_name)
WHEN 9 THEN concat('12.', cast(p_size AS string)) WHEN 10 THEN concat('  café ', p_name, '   Zoë ñ ') WHEN 11 THEN concat('"a "', p_name, '" c"') WHEN 12 THEN concat(p_name, ' - tail (end)') ELSE concat(p_name, ' [see] (end)') END"""


def _chain(c: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


SIMPLE = rf"""WITH a AS (SELECT p_partkey, strip_accents({MARKED}) AS x FROM part),
b AS (SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(x, '‚', ','), '„', ',,'), '·', '.'), '…', '...'), 'ˆ', '^'), '˜', '~'), '‹', '<'), '›', '>') AS x FROM a),
c AS (SELECT p_partkey, {_chain("x", ("[‘’´`]", "''"), ("[“”«»]", '"'), ("[•†‡]", ""), ("[‐‑–—]", "-"), (r"[\x{2E00}-\x{FFFF}]", ""), (r"\[(nb ?)?[0-9]+\]", ""), (r"\*+$", ""), (r"\([0-9]* ?-? ?[0-9]*\)", ""), ('^"(.*)"$', r"\1"))} AS x FROM b),
d AS (SELECT p_partkey, {WS.format("CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN x ELSE regexp_replace(x, '^[0-9]+[.]', '') END")} AS norm FROM c)"""
TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"{SIMPLE} SELECT p_partkey, norm FROM d")
def norm_simple(s, d):
    return table(s, d, "part").select("p_partkey", text.normalize(F.expr(MARKED), 2).alias("norm"))


@query(rf"""{SIMPLE}, e AS (SELECT p_partkey, {_chain(TRIM.format(_chain(TRIM.format("norm"), (r"\[[^\]]*\]", ""))), (r"[\x{7F}-\x{FFFF}]", ""))} AS x FROM d)
SELECT p_partkey, {WS.format(_chain(TRIM.format(_chain(TRIM.format("x"), (" - .*$", ""))), (r"\([^)]*\)$", "")))} AS norm FROM e""")
def norm_aggressive(s, d):
    return table(s, d, "part").select("p_partkey", text.normalize(F.expr(MARKED), 3).alias("norm"))


SHAPE = "array_to_string(list_transform(list_filter(list_zip(c, range(len(c))), lambda x: x[2] = 0 OR x[1] <> c[x[2]]), lambda x: x[1]), '')"


@query(f"""WITH a AS (SELECT p_partkey, string_split(regexp_replace(regexp_replace(regexp_replace(p_name, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g'), '') AS c FROM part)
SELECT p_partkey, {SHAPE} AS shape FROM a""")
def phrase_shape(s, d):
    return table(s, d, "part").select("p_partkey", text.phrase_shape(F.col("p_name")).alias("shape"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[0-9]+', '0', 'g'), '[A-Za-z0-9]+'))) AS words FROM documents")
def bag_of_words(s, d):
    return table(s, d, "documents").select("doc_id", text.bag_of_words(F.col("text")).alias("words"))


@query("SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+|[0-9]+') AS tokens FROM conversations")
def alnum_tokens(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.alnum_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH a AS (SELECT conv_id, turn, unnest(string_split({WS.format('text')}, ' ')) AS token FROM conversations)
SELECT conv_id, turn, count(*) AS n, count(try_cast(token AS DOUBLE)) AS n_cd FROM a GROUP BY ALL""")
def crude_tokens(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", ling.crude(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda x: x.pos == "CD")).cast("long").alias("n_cd")).groupBy("conv_id", "turn").agg(F.sum("n").alias("n"), F.sum("n_cd").alias("n_cd"))


STATS = """WITH c AS (SELECT {k}, {v} AS v, count(*) AS c FROM {t} GROUP BY ALL),
m AS (SELECT {k}, max(c) AS top FROM c GROUP BY ALL)
SELECT c.{k}, CAST(sum(c) AS BIGINT) AS size, count(*) AS "distinct", max(c) AS max_dup,
CASE WHEN count(*) FILTER (c = top) = 1 THEN max(v) FILTER (c = top) END AS majority,
round(CASE WHEN count(*) = 1 THEN 0 ELSE ln(sum(c)) - sum(c * ln(c)) / sum(c) END, 6) AS entropy,
round(CASE WHEN sum(c) <= 1 OR count(*) = 1 THEN 0 ELSE (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)) END, 6) AS normalized_entropy
FROM c JOIN m USING ({k}) GROUP BY c.{k}"""


def _stats(df, key, value):
    out = stats.multiset(df, [key], value)
    return out.withColumn("entropy", F.round("entropy", 6)).withColumn("normalized_entropy", F.round("normalized_entropy", 6))


@query(STATS.format(k="o_orderstatus", v="o_orderpriority", t="orders"))
def multiset_orders(s, d):
    return _stats(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(STATS.format(k="p_brand", v="p_type", t="part"))
def multiset_parts(s, d):
    return _stats(table(s, d, "part"), "p_brand", "p_type")


@query("""WITH c AS (SELECT p_brand, sum(DISTINCT CAST(p_size AS DOUBLE)) / count(p_size) AS mean, sum(DISTINCT CAST(p_size AS DOUBLE) * p_size) / count(p_size) AS square FROM part GROUP BY p_brand)
SELECT p_brand, round(mean, 6) AS mean, round(sqrt(square - mean * mean), 6) AS deviation FROM c""")
def mean_dev(s, d):
    return stats.mean_dev(table(s, d, "part"), ["p_brand"], "p_size").select("p_brand", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT p_partkey, list_filter([1 << i for i in range(31)], lambda p: p <= p_size) AS steps, list_filter(range(0, 101, 20), lambda i: i <= least(p_size * 2.0, 100)) AS pct, CAST(floor(least(greatest(p_size / 50.0, 0), 0.9999) * 10) AS INT) AS bin FROM part")
def quantized(s, d):
    return table(s, d, "part").select("p_partkey", stats.quantized(F.col("p_size")).alias("steps"), F.transform(stats.percents(F.col("p_size") / 50.0), lambda x: x.cast("long")).alias("pct"), stats.bin_of(F.col("p_size") / 50.0).alias("bin"))


@query("""WITH d AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS gold, b.p_name AS predicted FROM d a JOIN d b ON abs(length(a.p_name) - length(b.p_name)) <= 2 AND a.p_name <> b.p_name AND
list_min(list_transform(range(0, least(3, length(b.p_name))), lambda j: j + CAST(substr(a.p_name, 1, 1) <> substr(b.p_name, CAST(j AS INT) + 1, 1) AS INT) + levenshtein(substr(a.p_name, 2), substr(b.p_name, CAST(j AS INT) + 2)))) <= 2""")
def near_match_join(s, d):
    names = table(s, d, "part").select(F.col("p_name").alias("value"))
    return evaluation.near_pairs(names, names).where("gold <> predicted")


@query("""WITH n AS (SELECT count(*) AS n FROM customer)
SELECT c_custkey AS ex_id, 'train' AS split FROM customer, n WHERE c_custkey < CAST(floor(n * 0.8) AS BIGINT) UNION ALL SELECT c_custkey, 'test' FROM customer, n WHERE c_custkey >= CAST(floor(n * 0.7) AS BIGINT)""")
def train_test_split(s, d):
    """Customers are numbered from 0; the parts overlap."""
    return datasets.fraction_split(table(s, d, "customer").select(F.col("c_custkey").alias("ex_id")), 0.8, 0.3)


def _written(s, d):
    """Two data set files in the shared folder: a question for each nation of region 0, and for each of region 1."""
    root = shared_folder(s)
    n = table(s, d, "nation").select("n_regionkey", F.struct(F.col("n_name").alias("query"), F.array("n_name", F.concat(F.lit("x"), "n_name")).alias("entities")).alias("datum"), "n_nationkey")
    for name, region in (("a", 0), ("b", 1)):
        one = n.where(F.col("n_regionkey") == region).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "datum"))), lambda x: x.datum).alias("data"))
        one.coalesce(1).write.json(f"{root}/geo/{name}.json")
    return root


@query("""WITH n AS (SELECT n_name AS phrase, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation WHERE n_regionkey IN (0, 1))
SELECT phrase, 'train' AS split FROM n WHERE i < CAST(floor(c * 0.5) AS INT) UNION ALL SELECT phrase, 'test' FROM n WHERE i >= CAST(floor(c * 0.5) AS INT)""")
def dataset_union(s, d):
    return datasets.load(s, _written(s, d), "geo.a+b", 0.5, 0.5).select("phrase", "split")


@query("SELECT n_name AS phrase, CASE n_regionkey WHEN 0 THEN 'train' ELSE 'test' END AS split FROM nation WHERE n_regionkey IN (0, 1)")
def dataset_cross(s, d):
    return datasets.load(s, _written(s, d), "geo.a@b").select("phrase", "split")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY rank) = 1 THEN 1 ELSE 0 END AS fst FROM r)
SELECT o_orderkey, CAST(rank AS INT) AS rank, CAST(sum(fst) OVER (PARTITION BY o_custkey ORDER BY rank) AS INT) AS unique_rank FROM f""")
def rank_unique_rank(s, d):
    return ranking.ranked(table(s, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], "o_orderpriority").select("o_orderkey", F.col("rank").cast("int").alias("rank"), "unique_rank")


@query("""WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT o_custkey, min(rank) FILTER (o_orderstatus = 'F') AS first_true FROM r GROUP BY o_custkey)
SELECT k, round(count(*) FILTER (first_true <= k) / count(*), 6) AS accuracy FROM f, range(1, 11) t(k) GROUP BY k""")
def accuracy_at_k(s, d):
    r = ranking.ranked(table(s, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], "o_orderkey")
    first = r.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("rank"))).alias("t"))
    hist = first.groupBy("t").agg(F.count("*").alias("c")).groupBy().agg(F.sum("c").alias("n"), F.collect_list(F.when(F.col("t") <= 10, F.struct("t", "c"))).alias("h"))
    k = hist.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    return k.select("k", F.round(F.expr("aggregate(h, 0L, (a, x) -> a + if(x.t <= k, x.c, 0L))") / F.col("n"), 6).alias("accuracy"))


@query("""WITH f AS (SELECT l_orderkey, 'flag ' || l_returnflag AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, 'status ' || l_linestatus, l_discount FROM lineitem),
p(feature, weight) AS (VALUES ('flag A', 0.5), ('flag N', -0.25), ('status O', 2.0))
SELECT l_orderkey, round(sum(value * coalesce(weight, 0)), 4) AS score FROM f LEFT JOIN p USING (feature) GROUP BY l_orderkey""")
def feature_dot_product(s, d):
    l = table(s, d, "lineitem")
    f = l.select("l_orderkey", F.inline(F.array(F.struct(F.concat(F.lit("flag "), "l_returnflag").alias("feature"), F.col("l_quantity").alias("value")), F.struct(F.concat(F.lit("status "), "l_linestatus").alias("feature"), F.col("l_discount").alias("value")))))
    p = s.sql("select * from values ('flag A', 0.5D), ('flag N', -0.25D), ('status O', 2.0D) as t(feature, weight)")
    return ranking.dot(f, F.broadcast(p), ["l_orderkey"]).select("l_orderkey", F.round("score", 4).alias("score"))


@query("SELECT p_partkey, p_name AS feature FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 20)")
def count_prune(s, d):
    return features.common(table(s, d, "part").select("p_partkey", "p_brand", F.col("p_name").alias("feature")), ["p_brand"], 20).select("p_partkey", "feature")


SOFTMAX = """WITH x AS (SELECT p_brand, p_partkey, p_size / 10.0 AS score, CASE WHEN p_type LIKE '%PROMO%' THEN 1 ELSE 0 END AS reward FROM part),
m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY p_brand)) AS e FROM x),
z AS (SELECT *, sum(e) OVER (PARTITION BY p_brand) AS ze, sum(e * reward) OVER (PARTITION BY p_brand) AS zr FROM m)
SELECT p_partkey, round(e * reward / zr - e / ze, 9) AS q FROM z WHERE zr > 0"""


@query(SOFTMAX)
def softmax_expectation_diff(s, d):
    x = table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 10.0).alias("score"), F.col("p_type").contains("PROMO").cast("int").alias("reward"))
    return learning.expectation_difference(x, ["p_brand"]).select("p_partkey", F.round("q", 9).alias("q"))


@query("""WITH g AS (SELECT p_name AS feature, sum(p_size - 25.5) / 100 - 0.01 * 0.1 AS g FROM part GROUP BY p_name),
w AS (SELECT feature, 0.1 + CASE WHEN abs(g) < 1e-6 THEN 0 ELSE g / sqrt(1 + g * g) END AS w FROM g)
SELECT feature, round(CASE WHEN w > 0.05 THEN w - 0.05 WHEN w < -0.05 THEN w + 0.05 ELSE 0 END, 6) AS weight FROM w""")
def adagrad_step(s, d):
    g = table(s, d, "part").groupBy(F.col("p_name").alias("feature")).agg((F.sum(F.col("p_size") - 25.5) / 100).alias("g"))
    params = g.select("feature", F.lit(0.1).alias("weight"), F.lit(1.0).alias("squares"))
    return learning.adagrad(params, g, rate=1.0, decay=0.01, shrink=0.05).select("feature", F.round("weight", 6).alias("weight"))


@query(r"""SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '://([^/?#]*)', 1) FROM pages WHERE url LIKE '%/fr/%')""")
def blacklist_hosts(s, d):
    """Pages of hosts that have no French page."""
    p = table(s, d, "pages")
    return datasets.blacklisted(p, p.where("url like '%/fr/%'").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()).select("page_id")


@query("""SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def type_entity_counts(s, d):
    x = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return x.join(F.broadcast(table(s, d, "nation")), "n_nationkey").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("n").alias("n"))


NAV = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"


@query(f"SELECT page_id, {NAV} AS entities FROM pages")
def nav_link_list(s, d):
    n = html.nodes(table(s, d, "pages")).where("root_no = 0 and tag = 'a' and array_join(tags, '/') = 'html/body/nav/ul/li/a'")
    return n.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre_id", "full_text"))), lambda x: x.full_text).alias("entities"))


TITLE = "replace(replace(replace(replace(regexp_extract(html, '<{0}>(.*?)</{0}>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, CASE WHEN length(t) <= 140 THEN t END AS title, CASE WHEN length(h) <= 140 THEN h END AS h1 FROM (SELECT page_id, {WS.format(TITLE.format('title'))} AS t, {WS.format(TITLE.format('h1'))} AS h FROM pages)")
def page_titles(s, d):
    return html.written_titles(table(s, d, "pages"))


@query("SELECT page_id, tag, n FROM (SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM pages, (VALUES ('p'), ('a'), ('li'), ('b'), ('div'), ('h1'), ('br')) t(tag)) WHERE n > 0")
def tag_counts(s, d):
    n = html.nodes(table(s, d, "pages")).where("root_no = 0 and tag in ('p', 'a', 'li', 'b', 'div', 'h1', 'br')")
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query()
def page_nodes(s, d):
    return html.nodes(table(s, d, "pages")).groupBy("page_id", "root_no").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query()
def candidate_lists(s, d):
    return pages.candidates(table(s, d, "pages"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest list of every page: rank 1 by size, ties by root and path."""
    c = pages.candidates(table(spark, sf_dir, "pages")).withColumn("size", F.size("entities"))
    r = ranking.ranked(c, ["page_id"], "size", ["root_no", "xpath"], "entities")
    return r.where("rank = 1").select("page_id", "xpath", "size", "entities")


Q["top_candidate_per_page"] = flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL


from weftlist.plans import checked, lists  # noqa: E402, F401  they register their queries here
