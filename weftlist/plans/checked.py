"""Queries of word features, vectors, rewards, models and data sets over the relational tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlist.functions import ling, text
from weftlist.operators import candidates, evaluation, features, learning, lexical
from weftlist.plans.registry import SHAPE, query, table
from weftlist.sources import datasets

# A brand's part names as one list, written in several ways; the same text is read by both engines.
NAME = "CASE WHEN p_size % 5 = 0 THEN upper(p_name) WHEN p_size % 5 = 1 THEN concat(p_name, ' ', cast(p_size AS string)) WHEN p_size % 5 = 2 THEN concat('new ', p_name, ' page') ELSE p_name END"
PAGE = "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)"
ITEMS = f"SELECT {PAGE} AS page_id, p_partkey, {NAME} AS e, p_size FROM part"


def _groups(s, d):
    rows = table(s, d, "part").select(F.expr(PAGE).alias("page_id"), "p_partkey", F.expr(NAME).alias("e"))
    lists = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))), lambda x: x.e).alias("entities"))
    return lists.select("page_id", F.lit(0).alias("root_no"), F.lit(1).cast("long").alias("group_id"), F.transform("entities", lambda e, i: i).alias("node_ids"), "entities")


def _out(df):
    return df.select("page_id", "feature", F.round("value", 6).alias("value"))


def _counted(rows: str) -> str:
    return f"""(SELECT k, CAST(sum(c) AS DOUBLE) AS n, count(*) AS kinds, max(c) AS top, sum(c * ln(c)) AS cl, CASE WHEN count(*) FILTER (c = m) = 1 THEN max(v) FILTER (c = m) END AS won
        FROM (SELECT k, v, count(*) AS c, max(count(*)) OVER (PARTITION BY k) AS m FROM ({rows}) WHERE v IS NOT NULL GROUP BY k, v) GROUP BY k)"""


STEPS = "(VALUES (0), (20), (40), (60), (80), (100)) t(i)"


def _entropy(name: str, rows: str) -> str:
    return f"SELECT k AS page_id, '{name}-normalized-entropy' AS feature, round(1 - cl / n / ln(n), 6) AS value FROM {_counted(rows)} WHERE kinds > 1"


def _votes(name: str, rows: str) -> str:
    """The votes on (k, v), from the definition."""
    c = _counted(rows)
    return f"""{_entropy(name, rows)} UNION ALL SELECT k, '{name}-majority-ratio >= ' || i || '%', 1.0 FROM {c}, {STEPS} WHERE won IS NOT NULL AND i <= least(top / n * 100, 100)
        UNION ALL SELECT k, CASE WHEN n > 1 THEN '{name}-identical' ELSE '{name}-single' END, 1.0 FROM {c} WHERE won IS NOT NULL AND top / n >= 0.9
        UNION ALL SELECT k, '{name}-majority = ' || won, 1.0 FROM {c} WHERE won IS NOT NULL"""


def _percent(name: str, share: str, source: str) -> str:
    return f"SELECT k AS page_id, '{name} >= ' || i || '%' AS feature, 1.0 AS value FROM {source}, {STEPS} WHERE i <= least({share} * 100, 100)"


def _shape(c: str) -> str:
    chars = f"string_split(regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g'), '')"
    return SHAPE.replace("c[", "ch[").replace("list_zip(c,", "list_zip(ch,").replace("len(c)", "len(ch)"), chars


_SHAPED = f"SELECT page_id AS k, e, {_shape('e')[0]} AS shape FROM (SELECT *, {_shape('e')[1]} AS ch FROM ({ITEMS}))"
_WORDS = "len(string_split(shape, ' '))"
_POWERS = "(SELECT 1 << i AS p FROM range(20) r(i))"


@query(f"""{_entropy("entity :: entity", "SELECT page_id AS k, e AS v FROM (" + ITEMS + ")")}
UNION ALL SELECT page_id, 'entity :: entity-max-duplication >= ' || p, 1.0 FROM (SELECT page_id, max(c) AS m FROM (SELECT page_id, e, count(*) AS c FROM ({ITEMS}) GROUP BY ALL) GROUP BY page_id), {_POWERS} WHERE p <= m
UNION ALL {_votes("entity :: phrase-shape", "SELECT k, shape AS v FROM (" + _SHAPED + ")")}
UNION ALL {_votes("entity :: word-shape", "SELECT k, unnest(string_split(shape, ' ')) AS v FROM (" + _SHAPED + ")")}
UNION ALL {_votes("entity :: num-word", "SELECT k, CAST(" + _WORDS + " AS VARCHAR) AS v FROM (" + _SHAPED + ")")}
UNION ALL SELECT k, 'entity :: num-word-' || what || ' >= ' || p, 1.0 FROM (SELECT k, unnest(['mean', 'deviation']) AS what, unnest([m, sqrt(q - m * m)]) AS x FROM
    (SELECT k, sum(DISTINCT CAST({_WORDS} AS DOUBLE)) / count(*) AS m, sum(DISTINCT CAST({_WORDS} * {_WORDS} AS DOUBLE)) / count(*) AS q FROM ({_SHAPED}) GROUP BY k)), {_POWERS} WHERE p <= x""")
def features_entity_parts(s, d):
    return _out(features.entity(_groups(s, d)))


_TOKENS = f"SELECT page_id AS k, unnest(string_split(e, ' ')) AS v FROM ({ITEMS})"
_POS = f"SELECT k, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 'CD' ELSE 'UNK' END AS v FROM ({_TOKENS})"
_COLLAPSED = f"SELECT page_id AS k, CASE WHEN regexp_matches(e, '^[0-9]+$') THEN 'CD' WHEN regexp_matches(e, ' [0-9]+$') THEN 'UNK CD' ELSE 'UNK' END AS v FROM ({ITEMS})"


@query(f"""{_entropy("ling :: word-pos", _POS)}
UNION ALL {_percent("ling :: word-pos = CD", "cd / n", f"(SELECT k, count(*) FILTER (v = 'CD') AS cd, count(*) AS n FROM ({_POS}) GROUP BY k HAVING count(*) FILTER (v = 'CD') > 0)")}
UNION ALL {_percent("ling :: word-pos = UNK", "u / n", f"(SELECT k, count(*) FILTER (v = 'UNK') AS u, count(*) AS n FROM ({_POS}) GROUP BY k HAVING count(*) FILTER (v = 'UNK') > 0)")}
UNION ALL {_votes("ling :: entity-collapsed-pos", _COLLAPSED)}
UNION ALL {_entropy("ling :: first-token", f"SELECT page_id AS k, string_split(e, ' ')[1] AS v FROM ({ITEMS})")}
UNION ALL {_entropy("ling :: last-token", f"SELECT page_id AS k, string_split(e, ' ')[-1] AS v FROM ({ITEMS})")}""")
def features_ling_parts(s, d):
    return _out(lexical.linguistic(_groups(s, d)))


# Words by how many parts' names have them: the most frequent first.
_RANKS = "(SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w)"
_FREQ = f"""(SELECT k, count(*) AS n, count(*) FILTER (v IN ('new', 'page')) AS bad, count(*) FILTER (regexp_matches(v, '^[0-9]+$')) AS digits, count(*) FILTER (r <= 3) AS few, count(*) FILTER (r <= 8) AS many
    FROM (SELECT page_id AS k, unnest(regexp_extract_all(lower(e), '[a-z]+|[0-9]+')) AS v FROM ({ITEMS})) LEFT JOIN {_RANKS} ON w = v GROUP BY k)"""


@query(f"""{_percent("token-freq :: bad-words-ratio", "bad / n", _FREQ)} UNION ALL {_percent("token-freq :: digits-ratio", "digits / n", _FREQ)}
UNION ALL {_percent("token-freq :: frequent-3", "few / n", _FREQ)} AND few > 0 UNION ALL {_percent("token-freq :: frequent-8", "many / n", _FREQ)} AND many > 0""")
def features_token_freq(s, d):
    words = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = words.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("w")).select(F.posexplode("w").alias("place", "x")).select(F.col("x.word").alias("word"), "place")
    return _out(lexical.token_freq(_groups(s, d), datasets.word_ranks(order), (3, 8)))


# A made-up bit-string cluster for the words of part names: the binary form of their length and first letter.
BITS = "concat(lpad(bin(length({0}) * 37), 9, '0'), lpad(bin(ascii({0})), 7, '0'))"
_CLUSTERS = f"(SELECT DISTINCT w, {BITS.format('w')} AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
_PREFIXES = "['[4]' || left(c, 4), '[6]' || left(c, 6), '[10]' || left(c, 10), '[20]' || left(c, 20)]"
_ASKED = f"(SELECT DISTINCT page_id, q FROM (SELECT page_id, p AS q FROM (SELECT {PAGE} AS page_id, unnest(string_split(lower(p_type) || ' ' || p_name, ' ')) AS p FROM part WHERE p_size = 1) UNION ALL SELECT page_id, unnest({_PREFIXES}) FROM (SELECT {PAGE} AS page_id, unnest(string_split(lower(p_type) || ' ' || p_name, ' ')) AS p FROM part WHERE p_size = 1) JOIN {_CLUSTERS} ON w = p))"
_FOUND = f"SELECT page_id AS k, c AS v FROM (SELECT page_id, unnest(string_split(e, ' ')) AS p FROM ({ITEMS})) JOIN {_CLUSTERS} ON w = p"


@query(f"""SELECT page_id, 'cluster :: query = ' || q || ' | entity ~ ' || p AS feature, 1.0 AS value FROM {_ASKED} JOIN (SELECT DISTINCT k AS page_id, unnest({_PREFIXES}) AS p FROM (SELECT k, v AS c FROM ({_FOUND}))) USING (page_id)
UNION ALL SELECT page_id, 'cluster :: query = ' || q || ' | entity-normalized-entropy', coalesce(CASE WHEN kinds > 1 THEN round(1 - cl / n / ln(n), 6) ELSE 0 END, 0) FROM {_ASKED} LEFT JOIN {_counted(_FOUND)} ON k = page_id""")
def features_cluster(s, d):
    p = table(s, d, "part")
    clusters = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("cluster", F.expr(BITS.format("word")))
    asked = p.where("p_size = 1").select(F.expr(PAGE).alias("page_id"), F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("phrase"))
    return _out(lexical.cluster(_groups(s, d), asked, clusters))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND w IN ('is', 'may') THEN 'AUX' WHEN p_size % 4 IN (0, 1, 3) THEN 'OPEN' ELSE 'CLOSE' END AS kind FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'is' WHEN 1 THEN 'may' ELSE 'run' END AS w FROM part)""")
def pos_types(s, d):
    word = F.expr("case p_size % 3 when 0 then 'IS' when 1 then 'may' else 'run' end")
    tag = F.expr("case p_size % 4 when 0 then 'VBZ' when 1 then 'NN' when 2 then 'IN' else 'CD' end")
    return table(s, d, "part").select("p_partkey", ling.pos_type(tag, word).alias("kind"))


@query(f"""WITH t AS (SELECT p_partkey, string_split({NAME}, ' ') AS w FROM part)
SELECT p_partkey, list_sort(list_distinct(w)) AS words, w[-1] AS last, array_to_string(w[1:2], ' ') AS front, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) AS numbers FROM t""")
def annotated_names(s, d):
    t = ling.annotated(table(s, d, "part").select("p_partkey", F.expr(NAME).alias("e")), "e")
    words = F.array_sort(ling.token_set(F.col("tokens"), only_open=True))
    return t.select("p_partkey", words.alias("words"), ling.last_word(F.col("tokens")).alias("last"), ling.phrase_of(F.col("tokens"), F.lit(0), F.lit(2)).alias("front"), F.size(F.filter("tokens", lambda x: x.ner == "NUMBER")).cast("long").alias("numbers"))


@query("SELECT DISTINCT p_name AS phrase, len(string_split(p_name, ' ')) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)")
def annotation_misses(s, d):
    """Names that a cache of annotations lacks, annotated."""
    p = table(s, d, "part").select("p_name", "p_size")
    cache = ling.annotated(p.where("p_size < 3").select(F.col("p_name").alias("phrase")).distinct(), "phrase")
    return ling.missing(p, "p_name", cache).select("phrase", F.size("tokens").cast("long").alias("n"))


@query("SELECT p_partkey, coalesce(t, 'null') AS query_type FROM part LEFT JOIN (SELECT p_name AS q, min(p_type) AS t FROM part WHERE p_name LIKE 's%' GROUP BY p_name) ON q = p_name")
def query_types(s, d):
    p = table(s, d, "part")
    types = p.where("p_name like 's%'").groupBy(F.col("p_name").alias("query")).agg(F.min("p_type").alias("type"), F.min("p_name").alias("headword"))
    return ling.with_type(p.select("p_partkey", "p_name"), "p_name", types).select("p_partkey", "query_type")


@query(f"""WITH w AS (SELECT p_partkey, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT p_partkey, list_filter(string_split(regexp_replace(concat(p_name, ', ', p_size), '([,!:])', ' \\1 ', 'g'), ' '), lambda y: y <> '') AS x FROM part))
SELECT p_partkey, string_agg(CASE WHEN starts_with(w.w, 's') THEN {BITS.format('w.w')} WHEN regexp_matches(w.w, '[a-z]') THEN 'a' WHEN w.w = ',' THEN ',' ELSE '0' END, ' ' ORDER BY i) AS repn FROM w GROUP BY p_partkey""")
def cluster_shapes(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(", "), F.col("p_size").cast("string")).alias("phrase"), "p_name")
    clusters = p.select(F.explode(F.split("p_name", " ")).alias("word")).where("word like 's%'").distinct().withColumn("cluster", F.expr(BITS.format("word")))
    return ling.cluster_shape(p, ["p_partkey"], "phrase", clusters)


@query("SELECT c_custkey, ltrim(sha1(c_name), '0') AS hash FROM customer")
def sha1_numbers(s, d):
    return table(s, d, "customer").select("c_custkey", ling.sha1_number(F.col("c_name")).alias("hash"))


@query("""SELECT p_partkey, list_sort(['x-lemma ~ ' || a || '|' || b, 'x-lemma ~ ' || b || '|' || a, 'x-lemma ~ ' || a || '|' || a, 'x-lemma ~ ' || b || '|' || b, 'x-lemma SAME', 'x-lemma SAME']) AS names,
list_sort(['y ~ ' || a || '|' || t, 'y ~ ' || b || '|' || t]) AS pairs FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part)""")
def lemma_features(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.array_sort(lexical.lemma_names("x", ling.crude(F.col("p_name")), pairs=True)).alias("names"), F.array_sort(lexical.word_pairs("y", F.col("p_name"), F.col("p_type"))).alias("pairs"))


@query("SELECT p_partkey, list_sort(list_concat(['n-tag = ' || p_type], CASE WHEN p_size % 2 = 0 THEN ['n-id = row0'] ELSE [] END, ['n-class = c0', 'n-class = ' || string_split(p_name, ' ')[1]])) AS names FROM part")
def node_features(s, d):
    attrs = F.create_map(F.lit("id"), F.expr("if(p_size % 2 = 0, concat('row', p_size), '')"), F.lit("class"), F.expr("concat('c', p_size, '  ', split(p_name, ' ')[0])"))
    return table(s, d, "part").select("p_partkey", F.array_sort(lexical.node_names("n", F.col("p_type"), attrs)).alias("names"))


@query("SELECT DISTINCT p_brand, 'part :: type = ' || p_type AS feature, 1.0::DOUBLE AS value FROM part UNION ALL SELECT DISTINCT p_brand, 'part :: name ~ ' || w, 1.0 FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w, p_name FROM part GROUP BY p_brand, p_name)")
def distinct_features(s, d):
    p = table(s, d, "part")
    words = lexical.distinct_names(p, ["p_brand"], "part", "name", "p_name", words=True).distinct()
    return lexical.distinct_names(p, ["p_brand"], "part", "type", "p_type").unionByName(words)


@query("""SELECT p_partkey, list_sort(list_concat(CASE WHEN a + b > 0 THEN ['has-cut', 'has-cut | tag = li'] ELSE [] END, CASE WHEN a = 1 AND b = 0 THEN ['cut-first-only', 'cut-first-only | tag = li'] ELSE [] END, CASE WHEN a = 0 AND b = 1 THEN ['cut-last-only', 'cut-last-only | tag = li'] ELSE [] END,
CASE WHEN a > 0 THEN ['cut-front', 'cut-front | tag = li'] ELSE [] END, CASE WHEN b > 0 THEN ['cut-back', 'cut-back | tag = li'] ELSE [] END)) AS names FROM (SELECT p_partkey, p_size % 3 AS a, p_size % 2 AS b FROM part)""")
def cut_range_features(s, d):
    return table(s, d, "part").select("p_partkey", F.array_sort(lexical.cut_range_names(F.lit("/html[1]/body/ul/li"), F.col("p_size") % 3, F.col("p_size") % 2)).alias("names"))


@query("""WITH g AS (SELECT n_regionkey AS page_id, list(n_nationkey ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_regionkey)
SELECT page_id, CAST(i AS INT) AS cut_start, 0 AS cut_end, ids[2:] AS node_ids FROM g, range(5) t(i) WHERE i < least(5, len(ids) - 2)
UNION ALL SELECT page_id, 0, CAST(i AS INT), ids[1:len(ids) - i] FROM g, range(1, 10) t(i) WHERE i < least(10, len(ids) - 2)""")
def cut_ranges(s, d):
    g = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("node_ids"))
    return candidates.cut_ranges(g.withColumn("root_no", F.lit(0)).withColumn("group_id", F.lit(1))).select("page_id", "cut_start", "cut_end", "node_ids")


@query("""WITH x AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, 1.0 / (vec_id % 7 + 1) AS f, (vec_id % 3 = 0)::INT AS o FROM embeddings)
SELECT label, round(avg(a), 5) AS plain, round(sum(a * f) / sum(f), 5) AS weighted, round(sum(b * o) / sum(o), 5) AS opened, round(sum(b * o * f) / sum(o * f), 5) AS both, round(min_by(a, vec_id), 5) AS first FROM x GROUP BY label""")
def pooled_vectors(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("vector"), "label", "vec_id")
    words = e.select("label", F.col("vec_id").alias("place"), "word", F.expr("if(vec_id % 3 = 0, 'OPEN', 'CLOSE')").alias("pos_type"))
    out = lexical.pooled(words, ["label"], e.select("word", "vector"), e.select("word", F.expr("vec_id % 7").alias("frequency")))
    at = lambda c, i: F.round(F.col(c)[i], 5)
    return out.select("label", at("averaged", 0).alias("plain"), at("freq_weighted", 0).alias("weighted"), at("open_pos", 1).alias("opened"), at("freq_weighted_open_pos", 1).alias("both"), at("least", 0).alias("first"))


_E = "(SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"


def _pairs(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5 - 2.0).alias("q"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("x"), F.transform(F.slice("embedding", 2, 1), lambda x: x.cast("double")).alias("y"))


@query(f"SELECT vec_id, 'fake-wordvec :: [' || i || '][0]' AS feature, round(CASE i WHEN 0 THEN a ELSE b END * b, 6) AS value FROM {_E}, (VALUES (0), (1)) t(i) UNION ALL SELECT vec_id, 'wordvec :: v[' || i || ']', round(CASE i WHEN 0 THEN a * a ELSE b * b END, 6) FROM {_E}, (VALUES (0), (1)) t(i)")
def vector_features(s, d):
    p = _pairs(s, d)
    out = lexical.outer(p, ["vec_id"], "x", "y").unionByName(lexical.termwise(p, ["vec_id"], "wordvec", "v", "x", F.col("x")))
    return out.select("vec_id", "feature", F.round("value", 6).alias("value"))


@query(f"""WITH g AS (SELECT CAST(i AS INT) AS i, 0 AS j, sum((vec_id % 5 - 2.0) * CASE i WHEN 0 THEN a ELSE b END * b) - 0.01 * (i + 1) AS g FROM {_E}, (VALUES (0), (1)) t(i) GROUP BY i)
SELECT i, j, round(i + 1 + CASE WHEN abs(g) < 1e-6 THEN 0 ELSE 0.1 * g / sqrt(1 + g * g) END, 5) AS weight FROM g""")
def matrix_step(s, d):
    matrix = s.sql("select * from values (0, 0, 1D, 1D), (1, 0, 2D, 1D) as t(i, j, weight, squares)")
    return learning.matrix_update(matrix, learning.vector_gradient(_pairs(s, d))).select("i", "j", F.round("weight", 5).alias("weight"))


@query(f"""WITH p AS (SELECT vec_id % 5 - 2.0 AS q, a, b, r, CASE r WHEN 0 THEN 0.5 * a - b ELSE a + 2 * b END AS ux, CASE r WHEN 0 THEN 3 * b ELSE -b END AS vy FROM {_E}, (VALUES (0), (1)) t(r))
SELECT 'u' AS side, CAST(r AS INT) AS r, CAST(i AS INT) AS i, round(sum(q * vy * CASE i WHEN 0 THEN a ELSE b END), 4) AS g FROM p, (VALUES (0), (1)) t(i) GROUP BY r, i UNION ALL SELECT 'v', CAST(r AS INT), 0, round(sum(q * ux * b), 4) FROM p GROUP BY r""")
def low_rank_gradients(s, d):
    factors = s.sql("select * from values (0, array(0.5D, -1D), array(3D)), (1, array(1D, 2D), array(-1D)) as t(r, u, v)")
    return learning.low_rank_gradient(_pairs(s, d), factors).withColumn("g", F.round("g", 4))


_FEATURES = "SELECT o_custkey, 'p :: ' || o_orderpriority AS feature, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL"


@query(f"""WITH f AS ({_FEATURES}), t AS (SELECT o_custkey, 'p :: ' || o_orderpriority AS feature, CAST(count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS value FROM orders GROUP BY ALL)
SELECT o_custkey, feature, 'own' AS kind, value * CASE feature WHEN 'p :: 1-URGENT' THEN 2.0 WHEN 'p :: 5-LOW' THEN -1.0 ELSE 0 END AS contribution FROM f UNION ALL SELECT o_custkey, feature, 'difference', value * CASE feature WHEN 'p :: 1-URGENT' THEN 2.0 WHEN 'p :: 5-LOW' THEN -1.0 ELSE 0 END FROM t WHERE value <> 0""")
def explained_scores(s, d):
    params = s.sql("select * from values ('p :: 1-URGENT', 2D), ('p :: 5-LOW', -1D) as t(feature, weight)")
    o = table(s, d, "orders").select("o_custkey", F.concat(F.lit("p :: "), "o_orderpriority").alias("feature"), F.lit(1.0).alias("value"), "o_orderstatus")
    own = learning.explained(o, params, ["o_custkey"]).select("o_custkey", "feature", F.lit("own").alias("kind"), "contribution")
    diff = learning.difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), params, ["o_custkey"])
    return own.unionByName(diff.select("o_custkey", "feature", F.lit("difference").alias("kind"), "contribution"))


@query("SELECT o_orderkey, p = '1-URGENT' OR s = 'F' AS allowed, p <> '1-URGENT' OR s = 'F' AS others, starts_with(p, '5') AND p <> '5-LOW' IS FALSE AS exact, NOT regexp_matches(p, '^[1-3]-.*$') AS inverse FROM (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s FROM orders)")
def feature_matchers(s, d):
    f = F.expr("concat(if(o_orderstatus = 'F', 'basic', o_orderpriority), ' :: x')")
    p = F.col("o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", learning.of_domain(f, "1-URGENT").alias("allowed"), learning.of_domain(f, "1-URGENT", False).alias("others"), learning.matching(p, exact="5-LOW", pattern="5.*").alias("exact"), learning.matching(p, pattern="[1-3]-.*", inverse=True).alias("inverse"))


@query("""WITH n AS (SELECT c_custkey, f, m, l, f[1] || '.' AS fi, CASE WHEN m IS NOT NULL THEN m[1] || '.' END AS mi FROM (SELECT c_custkey, 'Ann' AS f, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'B.' ELSE 'Bea' END AS m, c_mktsegment AS l FROM customer))
SELECT c_custkey, list_concat([f || ' ' || l, l || ', ' || f, fi || ' ' || l, l || ', ' || fi], CASE WHEN length(m) > 2 THEN [f || ' ' || m || ' ' || l, l || ', ' || f || ' ' || m] ELSE [] END, CASE WHEN m IS NOT NULL THEN [f || ' ' || mi || ' ' || l, l || ', ' || f || ' ' || mi] ELSE [] END) AS forms FROM n""")
def person_names(s, d):
    middle = F.expr("case c_custkey % 3 when 0 then cast(null as string) when 1 then 'B.' else 'Bea' end")
    return table(s, d, "customer").select("c_custkey", evaluation.person_forms(F.lit("Ann"), middle, F.col("c_mktsegment")).alias("forms"))


_ANSWERS = """WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p, list(o_orderpriority ORDER BY o_totalprice, o_orderkey) AS g FROM orders GROUP BY o_custkey),
h AS (SELECT *, (coalesce(p[1] = g[1], false))::INT + (coalesce(p[2] = g[2], false))::INT + (coalesce(p[len(p)] = g[len(g)], false))::INT AS hit FROM x)"""


def _answers(s, d):
    lists = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "o_orderpriority"))), lambda r: r.o_orderpriority)
    x = table(s, d, "orders").groupBy("o_custkey").agg(lists("o_orderkey").alias("p"), lists("o_totalprice", "o_orderkey").alias("g"))
    return x.select("o_custkey", "p", "g", F.get("g", F.lit(0)).alias("first"), F.get("g", F.lit(1)).alias("second"), F.element_at("g", -1).alias("last"), (F.col("o_custkey") % 2 == 0).alias("detailed"))


@query(f"{_ANSWERS} SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN (hit = 3)::INT ELSE 1 END::DOUBLE AS reward, round(CASE WHEN o_custkey % 2 = 0 THEN hit / 3.0 ELSE 1 END, 6) AS f1 FROM h")
def reward_dispatch(s, d):
    """Lists of the same strings in other orders: wholly right unless first, second and last are asked for."""
    return evaluation.rewarded(_answers(s, d), "g", "p").select("o_custkey", "reward", F.round("f1", 6).alias("f1"))


@query("""WITH x AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n, count(*) FILTER (l_linenumber <= 2) AS g FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN CASE WHEN g > 0 THEN least(g, n) / g ELSE 0 END < 0.8 THEN 0.0 ELSE 1.0 END AS reward, CASE WHEN least(g, n) >= g - 0.8 THEN 1.0 ELSE 0.0 END AS raw FROM x""")
def recall_rewards(s, d):
    """The first lines' names among all of an order's: recall with a threshold, and raw."""
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.lit("name")).alias("p"), F.collect_list(F.when(F.col("l_linenumber") <= 2, F.lit("name"))).alias("g"))
    a = evaluation.rewarded(x, "g", "p", zero_one=False).select("l_orderkey", "reward")
    b = evaluation.rewarded(x, "g", "p", zero_one=False, criterion="raw").select("l_orderkey", F.col("reward").alias("raw"))
    return a.join(b, "l_orderkey")


_RANKED = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, (o_orderstatus = 'F')::INT * (1 + o_shippriority) AS reward, o_orderpriority AS e FROM (SELECT *, o_orderkey % 2 AS o_shippriority FROM orders)"


@query(f"""WITH r AS ({_RANKED}), b AS (SELECT o_custkey, min_by(e, [-reward, rank]) AS gold, min_by(e, rank) AS t FROM r WHERE reward > 0 GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN gold IS NULL THEN NULL ELSE (e = gold)::INT::DOUBLE END AS f1_on_best, CASE WHEN gold IS NULL THEN NULL ELSE (t = gold)::INT::DOUBLE END AS true_f1_on_best FROM r LEFT JOIN b USING (o_custkey) WHERE rank = 1""")
def f1_on_best(s, d):
    """Lists of one order's priority each: the first and the first rewarded against the best."""
    r = table(s, d, "orders").withColumn("reward", F.expr("if(o_orderstatus = 'F', 1 + o_orderkey % 2, 0)")).withColumn("e", F.array("o_orderpriority"))
    from weftlist.operators import ranking

    return evaluation.against_best(ranking.ranked(r, ["o_custkey"], "o_totalprice", ["o_orderkey"], "o_orderkey"), ["o_custkey"], "e")


@query(f"SELECT o_custkey, rank FROM ({_RANKED}) WHERE e = '1-URGENT'")
def seeded_candidates(s, d):
    from weftlist.operators import ranking

    r = ranking.ranked(table(s, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], "o_orderkey")
    return evaluation.containing(r.withColumn("seed", F.lit("1-URGENT")).withColumn("e", F.array("o_orderpriority")), "seed", "e", "exact").select("o_custkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH t AS (SELECT i, o_custkey % 2 AS side, o_custkey, min(o_orderkey % i) AS m, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders, (VALUES (1), (2), (3)) v(i) GROUP BY ALL),
a AS (SELECT i, side, count(*) FILTER (m = 0 AND f > 0) / count(*) AS acc, count(*) FILTER (f > 0) / count(*) AS oracle FROM t GROUP BY i, side)
SELECT CAST(i AS INT) AS iteration, round(max(acc) FILTER (side = 0), 6) AS train_accuracy, round(max(oracle) FILTER (side = 0), 6) AS train_oracle, round(max(acc) FILTER (side = 1), 6) AS test_accuracy, round(max(oracle) FILTER (side = 1), 6) AS test_oracle FROM a GROUP BY i""")
def learning_curve(s, d):
    """Accuracy and oracle on training and test customers after each of three passes."""
    passes = []
    for i in (1, 2, 3):
        c = table(s, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % i).alias("m"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
        c = c.withColumn("case", F.expr("if(f = 0, 'super-fail', if(m = 0, 'success', 'normal-fail'))")).withColumn("f1", F.lit(0.0))
        passes.append(tuple(evaluation.summary(c.where(F.col("o_custkey") % 2 == side)) for side in (0, 1)))
    out = evaluation.learning_curve(passes)
    return out.select("iteration", *[F.round(c, 6).alias(c) for c in ("train_accuracy", "train_oracle", "test_accuracy", "test_oracle")])


@query("SELECT 'test' AS prefix, k AS key, round(v, 6) AS value FROM (SELECT unnest(['n', 'accuracy', 'accuracy_found', 'oracle', 'mean_f1']) AS k, unnest([n::DOUBLE, s / n, s / f, f / n, 0.5]) AS v FROM (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) FILTER (o_orderstatus <> 'P') AS f FROM orders))")
def run_outputs(s, d):
    c = table(s, d, "orders").select(F.expr("case o_orderstatus when 'F' then 'success' when 'P' then 'super-fail' else 'normal-fail' end").alias("case"), F.lit(0.5).alias("f1"))
    return evaluation.outputs(evaluation.summary(c), "test").withColumn("value", F.round("value", 6))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'hash' WHEN 1 THEN 'url' WHEN 2 THEN 'wiki' ELSE 'search' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'h' || c_custkey WHEN 1 THEN 'http://x/' || c_custkey WHEN 2 THEN replace(c_mktsegment || ' list', ' ', '_') ELSE 'list of ' || c_name END AS key FROM customer")
def page_sources(s, d):
    c = table(s, d, "customer").select("c_custkey", F.expr("if(c_custkey % 4 < 2, 'cache', null)").alias("cache_directory"), F.expr("if(c_custkey % 4 = 0, concat('h', c_custkey), null)").alias("hashcode"), F.expr("if(c_custkey % 4 = 1, concat('http://x/', c_custkey), null)").alias("url"), F.expr("if(c_custkey % 4 = 2, concat('wiki:', c_mktsegment, ' list'), c_name)").alias("phrase"))
    return datasets.source_of(c).select("c_custkey", "kind", "key")


@query("SELECT c_custkey AS ex_id, count(*) AS n FROM (SELECT c_custkey FROM customer) GROUP BY ALL")
def reshuffled_examples(s, d):
    """Shuffled and split again: each example keeps one place."""
    e = datasets.fraction_split(table(s, d, "customer").select(F.col("c_custkey").alias("ex_id")), 0.8, 0.2)
    return datasets.reshuffled(e, 2).groupBy("ex_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'li/ul' AS tail, CASE WHEN p_size % 2 = 0 THEN 'li[*]/ul' ELSE 'li/ul' END AS star, CASE WHEN p_size % 2 = 0 THEN 'ul/li[' || p_size || ']' ELSE 'ul/li' END AS whole FROM part")
def path_suffixes(s, d):
    x = F.expr("concat('/html[1]/body/ul/li', if(p_size % 2 = 0, concat('[', p_size, ']'), ''))")
    return table(s, d, "part").select("p_partkey", learning.path_suffix(x, 2).alias("tail"), learning.path_suffix(x, 2, indices="star").alias("star"), learning.path_suffix(x, 2, True, "full").alias("whole"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN string_split(p_name, ' ')[2] WHEN 1 THEN 'in' ELSE p_type END AS head FROM part")
def head_words(s, d):
    """The last noun before a preposition, the last word of a name that is one, and the last word that is no number."""
    tok = lambda token, pos, ner: f"named_struct('token', {token}, 'lemma', {token}, 'pos', '{pos}', 'pos_type', 'OPEN', 'ner', '{ner}', 'ner_value', '')"
    a, b = "split(p_name, ' ')[0]", "split(p_name, ' ')[1]"
    cases = [f"array({tok(a, 'JJ', 'O')}, {tok(b, 'NN', 'O')}, {tok(a, 'JJ', 'O')}, {tok(chr(39) + 'in' + chr(39), 'IN', 'O')}, {tok('p_type', 'NN', 'O')})", f"array({tok(a, 'NN', 'PERSON')}, {tok(chr(39) + 'in' + chr(39), 'IN', 'O')}, {tok('p_brand', 'CD', 'O')})", f"array({tok('p_type', 'NN', 'O')}, {tok(b, 'CD', 'NUMBER')})"]
    tokens = F.expr(f"case p_size % 3 when 0 then {cases[0]} when 1 then {cases[1]} else {cases[2]} end")
    return table(s, d, "part").withColumn("t", tokens).select("p_partkey", ling.head_word(F.col("t"), F.col("t")).alias("head"))


@query("SELECT p_partkey, upper(p_name) AS norm, 'A A' AS shape, list_sort(list_distinct(string_split(upper(p_name), ' '))) AS bag, string_split(p_name, ' ') AS tokens FROM part")
def sql_functions(s, d):
    """The functions registered for SQL, called from SQL."""
    from weftlist.functions import sql

    sql.register(s)
    table(s, d, "part").createOrReplaceTempView("weftlist_part")
    return s.sql("SELECT p_partkey, list_ws_normalize(concat('  ', replace(upper(p_name), ' ', '  '))) AS norm, list_phrase_shape(upper(p_name)) AS shape, list_bag_of_words(upper(p_name)) AS bag, list_tokens(upper(p_name)) AS tokens FROM weftlist_part")


@query("SELECT p.page_id, len(regexp_extract_all(p.html, '<li[ >]')) AS items FROM pages p")
def sql_html_nodes(s, d):
    """The page parser as a table function in SQL."""
    from weftlist.functions import sql

    sql.register(s)
    table(s, d, "pages").createOrReplaceTempView("weftlist_pages")
    return s.sql("SELECT p.page_id, count_if(n.tag = 'li' AND n.root_no = 0) AS items FROM weftlist_pages p, LATERAL html_nodes(p.html) n GROUP BY p.page_id")


FACTS = """WITH f AS (SELECT 'fb:m' || p_partkey AS e, p_name AS entity, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN ' city/day' ELSE ' glass' END AS t FROM part WHERE p_size % 5 <> 0)"""


def _facts(s, d):
    p = table(s, d, "part").select(F.expr("concat(if(p_size % 5 = 0, 'fb:user', 'fb:m'), p_partkey)").alias("id"), "p_name", F.expr("concat(lower(p_type), if(p_size % 2 = 0, ' city/day', ' glass'))").alias("t"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"@en.'))
    names = p.select("id", quoted(F.col("p_name")).alias("name")).unionByName(p.select(F.concat(F.lit("fb:t"), F.md5("t")).alias("id"), quoted(F.col("t")).alias("name")).distinct())
    return names, p.select(F.col("id").alias("entity_id"), F.concat(F.lit("fb:t"), F.md5("t"), F.lit(".")).alias("type_id"))


@query(f"{FACTS} SELECT t AS type, entity, count(*) AS n FROM f GROUP BY ALL")
def typed_entities(s, d):
    from weftlist.operators import typed

    return typed.pairs(*_facts(s, d)).groupBy("type", "entity").agg(F.count("*").alias("n"))


@query(f"""{FACTS}, h AS (SELECT unnest(CASE WHEN contains(t, 'glass') THEN ['glasses'] ELSE ['cities', 'daies'] END) AS head, CASE WHEN starts_with(entity, 's') THEN 'S a' ELSE 'a a' END AS r FROM f)
SELECT 'head' AS kind, CASE WHEN starts_with(head, 'd') THEN 'D' ELSE 'a' END AS left_repn, r AS entity_repn, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'type', t, CASE WHEN starts_with(entity, 's') THEN 'S a' ELSE 'a a' END, count(*) FROM f GROUP BY ALL""")
def typed_counts(s, d):
    """Counts by type and by the plural of its head; the clusters are S for names' first words with s, D for the plural of day."""
    from weftlist.operators import typed

    first = table(s, d, "part").select(F.split("p_name", " ")[0].alias("word")).distinct().where("word like 's%'").withColumn("cluster", F.lit("S"))
    second = table(s, d, "part").select(F.split("p_name", " ")[1].alias("word")).distinct()
    clusters = first.join(second, "word", "left_anti").unionByName(s.createDataFrame([("daies", "D")], "word string, cluster string"))
    a, b = typed.counts(typed.pairs(*_facts(s, d)), clusters)
    return b.select(F.lit("head").alias("kind"), F.col("type_repn").alias("left_repn"), "entity_repn", "n").unionByName(a.select(F.lit("type").alias("kind"), F.col("type").alias("left_repn"), "entity_repn", "n"))


@query("""WITH r AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey FROM r WHERE k = 1""")
def predicted_answers(s, d):
    """The best finished order of each customer, null for one without."""
    from weftlist.operators import presets

    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("entities"), "o_orderstatus")
    return presets.answers(table(s, d, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderkey"], F.expr("o_orderstatus = 'F'")).select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def beam_of_three(s, d):
    from weftlist.operators import presets

    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("entities"))
    return presets.beam(o, ["o_custkey"], ["o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT event_id, unnest([value / 100, value / 100 * value / 100]) AS v, generate_subscripts([1, 2], 1) AS i FROM events WHERE value BETWEEN 0 AND 100")
def quadratic_shares(s, d):
    from weftlist.functions import stats

    e = table(s, d, "events").where("value between 0 and 100")
    return e.select("event_id", F.posexplode(stats.quadratic(F.col("value") / 100)).alias("i", "v")).select("event_id", "v", (F.col("i") + 1).cast("long").alias("i"))


@query("""WITH x AS (SELECT p_partkey, ['html', 'body', 'ul', 'li'] AS t, [true, false, p_size % 2 = 0, p_size % 3 = 0] AS i FROM part)
SELECT p_partkey, 'path-tail :: /' || array_to_string(t[5 - k:4], '/') AS feature FROM x, range(1, 5) r(k)
UNION ALL SELECT p_partkey, 'path-tail :: (n-' || k || ')-tag = ' || t[5 - k] FROM x, range(1, 5) r(k)
UNION ALL SELECT p_partkey, 'path-tail :: (n-' || k || ')-indexed = ' || i[5 - k] FROM x, range(1, 5) r(k)
UNION ALL SELECT p_partkey, 'path-tail :: (n-' || k || ')-tag-indexed = ' || t[5 - k] || ' ' || i[5 - k] FROM x, range(1, 5) r(k)""")
def features_path_tail_parts(s, d):
    xpath = F.expr("concat('/html[1]/body/ul', if(p_size % 2 = 0, '[2]', ''), '/li', if(p_size % 3 = 0, '[1]', ''))")
    return features.path_tail(table(s, d, "part").select("p_partkey", xpath.alias("xpath")), ["p_partkey"]).select("p_partkey", "feature")


# A page for each region: a list for each nation with suppliers, an item for each supplier; nodes numbered in document order.
_PLACES = """WITH n AS (SELECT n_regionkey AS page_id, n_nationkey, count(*) AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey),
u AS (SELECT *, 1 + coalesce(sum(c + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, count(*) OVER (PARTITION BY page_id) AS lists FROM n),
s AS (SELECT page_id, n_nationkey, i, c, pre, lists, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS j FROM supplier JOIN u ON s_nationkey = n_nationkey)"""


def _supplier_pages(s, d):
    for name in ("nation", "supplier"):
        table(s, d, name).createOrReplaceTempView(name)
    node = "int(pre + 1 + j) AS pre_id, int(pre) AS parent_id, 4 AS depth, 'li' AS tag, int(j) AS child_idx, int(c) AS n_sib, 0 AS n_children, array(0, int(pre)) AS ancestors, array('html', 'ul', 'li') AS tags"
    above = "SELECT page_id, int(pre) AS pre_id, 0 AS parent_id, 3 AS depth, 'ul' AS tag, int(i) AS child_idx, int(lists) AS n_sib, int(c) AS n_children, array(0) AS ancestors, array('html', 'ul') AS tags FROM u"
    top = "SELECT DISTINCT page_id, 0 AS pre_id, cast(null AS int) AS parent_id, 2 AS depth, 'html' AS tag, 0 AS child_idx, 1 AS n_sib, int(lists) AS n_children, cast(array() AS array<int>) AS ancestors, array('html') AS tags FROM u"
    nodes = s.sql(f"{_PLACES} SELECT page_id, {node} FROM s UNION ALL {above} UNION ALL {top}")
    nodes = nodes.withColumns({"root_no": F.lit(0), "child_idx_tag": F.col("child_idx"), "n_sib_tag": F.col("n_sib"), "attrs": F.expr("cast(map() as map<string,string>)")})
    chosen = s.sql(f"{_PLACES} SELECT page_id, array_sort(collect_list(int(pre + 1 + j))) AS node_ids FROM s WHERE s_suppkey % 3 <> 0 GROUP BY page_id")
    return nodes, chosen.select("page_id", F.lit(0).alias("root_no"), F.lit(1).cast("long").alias("group_id"), "node_ids", F.transform("node_ids", lambda x: x.cast("string")).alias("entities"))


@query(f"""{_PLACES}, g AS (SELECT page_id, min(pre + 2 + j) FILTER (s_suppkey % 3 <> 0) AS low, max(pre + 2 + j) FILTER (s_suppkey % 3 <> 0) AS high, 1 + max(lists) + count(*) AS n FROM s GROUP BY page_id),
v AS (SELECT page_id, unnest(['length', 'start', 'end']) AS what, unnest([(high - low) / n, low / n, high / n]) AS x FROM g WHERE low IS NOT NULL)
SELECT page_id, 'node-range :: ' || what || ' >= ' || i || '%' AS feature, 1.0 AS value FROM v, {STEPS} WHERE i <= least(x * 100, 100)""")
def features_node_range_suppliers(s, d):
    return _out(features.node_range(*_supplier_pages(s, d)))


_HOLES = "[CASE WHEN bool_or(n = 1) THEN 'single' END, CASE WHEN bool_or(n > 1 AND n = a) THEN 'any-all' END, CASE WHEN bool_or(n > 1 AND n = a) THEN 'tag-all' END, CASE WHEN bool_or(low > 0) THEN 'any-hole-top' END, CASE WHEN bool_or(low > 0) THEN 'tag-hole-top' END, CASE WHEN bool_or(high - low + 1 <> n) THEN 'any-hole-middle' END, CASE WHEN bool_or(high - low + 1 <> n) THEN 'tag-hole-middle' END, CASE WHEN bool_or(high < a - 1) THEN 'any-hole-bottom' END, CASE WHEN bool_or(high < a - 1) THEN 'tag-hole-bottom' END]"


@query(f"""{_PLACES}, p AS (SELECT page_id, n_nationkey, i, lists, count(*) AS n, min(j) AS low, max(j) AS high, max(c) AS a FROM s WHERE s_suppkey % 3 <> 0 GROUP BY ALL),
q AS (SELECT page_id, count(*) AS n, min(i) AS low, max(i) AS high, max(lists) AS a FROM p GROUP BY page_id),
f AS (SELECT page_id, 'ul/li-' AS pre, unnest({_HOLES}) AS x FROM p GROUP BY page_id UNION ALL SELECT page_id, 'html/ul-', unnest({_HOLES}) FROM q GROUP BY page_id)
SELECT page_id, 'hole :: ' || pre || x AS feature, 1.0 AS value FROM f WHERE x IS NOT NULL""")
def features_hole_suppliers(s, d):
    return _out(features.hole(*_supplier_pages(s, d)))


@query(f"""{_PLACES}, k AS (SELECT page_id, n_nationkey, lists, i, count(*) AS n, max(c) AS a FROM s WHERE s_suppkey % 3 <> 0 GROUP BY ALL),
li AS (SELECT page_id AS k, CAST(j AS VARCHAR) AS v FROM s WHERE s_suppkey % 3 <> 0), ul AS (SELECT page_id AS k, CASE WHEN a <= 3 THEN CAST(a AS VARCHAR) ELSE 'many' END AS c, CAST(i AS VARCHAR) AS v FROM k), top AS (SELECT page_id AS k, sum(n) AS n, sum(a) AS a, count(*) AS lists, max(lists) AS whole FROM k GROUP BY page_id),
one AS ({_votes("tag", "SELECT k, 'li' AS v FROM li")} UNION ALL {_votes("num-children", "SELECT k, '0' AS v FROM li")} UNION ALL {_votes("child-index", "SELECT k, v FROM li")} UNION ALL {_percent("children-of-parent", "n / a", "top")} UNION ALL SELECT k, 'same-parent', 1.0 FROM top WHERE lists = 1),
two AS ({_votes("tag", "SELECT k, 'ul' AS v FROM ul")} UNION ALL {_votes("num-children", "SELECT k, c AS v FROM ul")} UNION ALL {_votes("child-index", "SELECT k, v FROM ul")} UNION ALL {_percent("children-of-parent", "lists / whole", "top")} UNION ALL SELECT k, 'same-parent', 1.0 FROM top)
SELECT page_id, 'self-or-ancestors :: ' || feature AS feature, round(sum(value), 6) AS value FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE NOT (starts_with(feature, 'child-index-majority =') AND page_id IN (SELECT k FROM top WHERE n = 1)) GROUP BY page_id, feature""")
def features_ancestors_suppliers(s, d):
    """The items chosen and their lists; the page's root is no level of its own."""
    nodes, groups = _supplier_pages(s, d)
    return _out(features.self_or_ancestors(nodes.where("depth > 2"), groups))
