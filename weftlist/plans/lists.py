"""Queries of features, evaluation and learning, registered beside those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlist.functions import text
from weftlist.operators import evaluation, features, learning, pages, ranking
from weftlist.plans.registry import query, shared_folder, table

KEYS = features.KEYS


def _kept(df, name):
    """``df`` written to the shared folder and read again: pages are parsed once, however often their lists are used."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _groups(s, d, level=0, climb=0):
    """Groups of all pages, dealt out once by group. Their number of parts is given, as a group is few bytes but many rows later."""
    groups = _kept(pages.groups(table(s, d, "pages"), level, climb=climb), "groups")
    return groups.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def _candidates(s, d):
    return pages.candidates(table(s, d, "pages"))


@query()
def features_self_or_ancestors(s, d):
    return features.ancestor_votes(pages.levels(_groups(s, d, climb=5)))


@query()
def features_node_range(s, d):
    groups = pages.groups(table(s, d, "pages"))
    return features.places(groups, F.array_min("node_ids") + 1, F.array_max("node_ids") + 1, F.col("n_nodes"))


@query()
def features_hole(s, d):
    return features.holes(pages.levels(pages.groups(table(s, d, "pages"), climb=5)))


@query()
def features_entity(s, d):
    return features.entity(_groups(s, d, 2)).withColumn("value", F.round("value", 6))


@query()
def features_path_tail(s, d):
    return features.path_tail(_candidates(s, d), ["page_id", "root_no", "xpath"])


VOTES = """WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, sum(c) AS size, count(*) AS kinds, max(c) AS top, sum(c * ln(c)) AS clnc FROM c GROUP BY o_custkey),
w AS (SELECT g.*, CASE WHEN count(*) = 1 THEN max(c.v) END AS won FROM g JOIN c ON g.o_custkey = c.o_custkey AND c.c = g.top GROUP BY ALL),
f AS (SELECT o_custkey, 'p-majority-ratio >= ' || i || '%' AS f FROM w, (VALUES (0), (20), (40), (60), (80), (100)) t(i) WHERE won IS NOT NULL AND i <= least(top / size * 100, 100)
UNION ALL SELECT o_custkey, CASE WHEN size > 1 THEN 'p-identical' ELSE 'p-single' END FROM w WHERE won IS NOT NULL AND top / size >= 0.9
UNION ALL SELECT o_custkey, 'p-majority = ' || won FROM w WHERE won IS NOT NULL AND size > 1)
SELECT o_custkey, 'orders :: ' || f AS feature, 1.0::DOUBLE AS value FROM f
UNION ALL SELECT o_custkey, 'orders :: p-normalized-entropy', round(1 - clnc / size / ln(size), 6) FROM w WHERE kinds > 1"""


@query(VOTES)
def voting_features(s, d):
    rows = table(s, d, "orders").select("o_custkey", F.lit("p").alias("name"), F.col("o_orderpriority").alias("value"), F.lit(False).alias("words"), F.lit(False).alias("lone"), F.lit(False).alias("only_entropy"))
    return features.voting(rows, ["o_custkey"], "orders").withColumn("value", F.round("value", 6))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'E') THEN coalesce(p_brand, 'null') ELSE 'ALL' END || ' ' || p_type AS feature FROM part")
def conjoin_query_type(s, d):
    return features.conjoin(table(s, d, "part").select("p_partkey", "p_brand", F.col("p_type").alias("feature")), "p_brand", "^E.*").select("p_partkey", "feature")


IR = """WITH a AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS g FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linestatus AS v, count(*) AS p FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, sum(least(g, p)) AS correct FROM a JOIN b USING (l_orderkey, v) GROUP BY ALL)
SELECT l_orderkey, CAST(coalesce(correct, 0) AS INT) AS correct, round(coalesce(correct, 0) / size, 6) AS "precision", round(coalesce(correct, 0) / size, 6) AS f1 FROM n LEFT JOIN m USING (l_orderkey)"""


@query(IR)
def ir_exact_match(s, d):
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("gold"), F.collect_list("l_linestatus").alias("predicted"))
    return evaluation.scored(x, "gold", "predicted", "exact").select("l_orderkey", "correct", F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"))


@query()
def ir_near_match(s, d):
    """Names of a brand's parts of odd keys against those of even keys, matched one to one."""
    p = table(s, d, "part")
    x = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 10).alias("block")).agg(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")))).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))).alias("predicted"))
    return evaluation.scored(x, "gold", "predicted").select("p_brand", "block", "correct", "precision", "recall", "f1", "exact")


@query("""WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS e FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST((coalesce(e[1] = '1-URGENT', false))::INT + (coalesce(e[2] = '5-LOW', false))::INT + (coalesce(e[len(e)] = '2-HIGH', false))::INT AS INT) AS matched FROM x""")
def general_web_criteria(s, d):
    x = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda r: r.o_orderpriority).alias("e"))
    return x.select("o_custkey", evaluation.general_web(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("2-HIGH"), F.col("e")).alias("matched"))


CASES = """WITH r AS (SELECT o_custkey, (o_orderstatus = 'F')::INT AS reward, o_totalprice AS f1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT o_custkey, o_custkey % 3 AS fold, min(rank) FILTER (reward > 0) AS t FROM r GROUP BY o_custkey)"""


def _cases(s, d):
    o = table(s, d, "orders").withColumn("reward", (F.col("o_orderstatus") == "F").cast("double")).withColumn("f1", F.col("reward"))
    return evaluation.cases(ranking.ranked(o, ["o_custkey"], "o_totalprice", ["o_orderkey"], "o_orderkey"), ["o_custkey"])


@query(f"{CASES} SELECT CASE WHEN t IS NULL THEN 'super-fail' WHEN t > 1 THEN 'normal-fail' ELSE 'success' END AS \"case\", count(*) AS n FROM t GROUP BY ALL")
def case_classes(s, d):
    return _cases(s, d).groupBy("case").agg(F.count("*").alias("n"))


@query(f"""{CASES}, f AS (SELECT fold, count(*) FILTER (t = 1) / count(*) AS accuracy, count(t) / count(*) AS oracle FROM t GROUP BY fold)
SELECT round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_sd, round(avg(oracle), 9) AS oracle_mean, round(stddev_pop(oracle), 9) AS oracle_sd FROM f""")
def fold_statistics(s, d):
    out = evaluation.over_folds(evaluation.summary(_cases(s, d).withColumn("fold", F.col("o_custkey") % 3), ["fold"]), ["accuracy", "oracle"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query()
def train_path_ranker(s, d):
    """Weights of path features after five passes, where a page's navigation lists are what was asked for."""
    c = _kept(_candidates(s, d), "candidates")
    keys = ["page_id", "root_no", "xpath"]
    f = features.common(features.path_tail(c, keys), ["page_id"])
    rewards = c.select(*keys, F.contains("xpath", F.lit("nav")).cast("double").alias("reward"))
    out = learning.train(f, rewards, ["page_id"], ["root_no", "xpath"], folder=shared_folder(s))
    return learning.prune(out, 1e-4).select("feature", F.round("weight", 6).alias("weight"))


@query()
def baseline_suffixes(s, d):
    c = _candidates(s, d)
    return learning.suffix_counts(c.withColumn("reward", F.contains("xpath", F.lit("nav")).cast("int")))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, round(x * (0.5 * x - y) + y * (2.0 * x + 0.25 * y), 6) AS score FROM e""")
def bilinear_score(s, d):
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    matrix = F.array(F.array(F.lit(0.5), F.lit(-1.0)), F.array(F.lit(2.0), F.lit(0.25)))
    return table(s, d, "embeddings").select("vec_id", F.round(learning.bilinear(x, matrix, x), 6).alias("score"))


@query("SELECT p_partkey, [ '[4]' || left(p_name, 4), '[6]' || left(p_name, 6), '[10]' || left(p_name, 10), '[20]' || left(p_name, 20)] AS prefixes FROM part")
def cluster_prefixes(s, d):
    return table(s, d, "part").select("p_partkey", text.cluster_prefixes(F.col("p_name")).alias("prefixes"))


@query("SELECT p_partkey, regexp_replace(regexp_replace('name of ' || p_name || ' wiki', ' wiki(pedia)?$', ''), '^(type|name) of ', '') AS phrase FROM part")
def hack_phrase(s, d):
    return table(s, d, "part").select("p_partkey", text.hack_phrase(F.concat(F.lit("name of "), "p_name", F.lit(" wiki"))).alias("phrase"))


@query("SELECT o_custkey, CASE WHEN len(e) <= 30 THEN e ELSE e[1:27] || e[len(e) - 3:len(e)] END AS shown FROM (SELECT o_custkey, list(left(o_orderpriority, 60) ORDER BY o_orderkey) AS e FROM orders GROUP BY o_custkey)")
def sampled_list(s, d):
    x = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda r: r.o_orderpriority).alias("e"))
    return x.select("o_custkey", text.sampled(F.col("e")).alias("shown"))
