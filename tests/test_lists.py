"""Features, evaluation, learning, datasets and requests on small tables."""

import itertools
import json
import random

from pyspark.sql import functions as F

from weftlist.functions import text
from weftlist.operators import candidates, evaluation, features, learning
from weftlist.sources import datasets, html
from weftlist.streaming import requests

PAGE = "<html><body><h1>Fruit</h1><ul id='x' class='big list'>" + "".join(f"<li>{w}</li>" for w in ("apple", "pear", "quince tree", "plum")) + "</ul><p>end</p></body></html>"


def pages(spark):
    return spark.createDataFrame([(1, "http://a.org/", PAGE)], "page_id long, url string, html string")


def grouped(spark):
    nodes = html.nodes(pages(spark)).where("root_no = 0")
    cands = candidates.candidates(nodes)
    return nodes, cands, candidates.groups(cands).withColumn("group_id", F.xxhash64("node_ids"))


def test_group_features(spark):
    nodes, cands, groups = grouped(spark)
    items = groups.where("entities[0] = 'apple' and size(entities) = 4 and exists(xpaths, p -> p like '%/li')")
    assert items.count() == 1
    own = {r.feature: r.value for r in features.self_or_ancestors(nodes, items).collect()}
    assert own["self-or-ancestors :: tag-majority = li"] == 1 and own["self-or-ancestors :: class-majority ~ big"] == 1
    assert own["self-or-ancestors :: same-parent"] == 4  # at each level up to the root
    holes = {r.feature for r in features.hole(nodes, items).collect()}
    assert {"hole :: ul/li-any-all", "hole :: ul/li-tag-all", "hole :: body/ul-any-hole-top", "hole :: body/ul-any-hole-bottom", "hole :: body/ul-single"} <= holes
    assert not any("ul/li-any-hole" in h for h in holes)
    entity = {r.feature: r.value for r in features.entity(items).collect()}
    assert "entity :: phrase-shape-majority = a" in entity and "entity :: num-word-mean >= 1" not in entity
    assert abs(entity["entity :: entity-normalized-entropy"] - 1) < 1e-9 and "entity :: entity-max-duplication >= 1" in entity and "entity :: entity-max-duplication >= 2" not in entity
    numbers = {r.feature: r.value for r in features.entity(items, steps=False, collapsed=True, count=True).collect()}
    assert numbers["entity :: num-word-mean"] == 3 / 4 and "entity :: num-entities >= 4" in numbers and "entity :: collapsed-phrase-shape-majority = a" in numbers
    assert own["self-or-ancestors :: id-majority ~ x"] == own["self-or-ancestors :: id-single"] == 1  # elements without one don't vote
    places = sorted(items.first().node_ids)
    total = nodes.where(F.col("page_id") == items.first().page_id).count()
    span = {r.feature for r in features.node_range(nodes, items).collect()}
    for name, share in (("length", (places[-1] - places[0]) / total), ("start", (places[0] + 1) / total), ("end", (places[-1] + 1) / total)):
        assert {f for f in span if f"{name} " in f} == {f"node-range :: {name} >= {i}%" for i in range(0, 101, 20) if i <= min(share * 100, 100)}
    tail = {r.feature for r in features.path_tail(cands.where("xpath = '/html[1]/body/ul/li'"), ["xpath"]).collect()}
    assert {"path-tail :: /ul/li", "path-tail :: (n-1)-tag = li", "path-tail :: (n-4)-indexed = true"} <= tail


def test_feature_options(spark):
    from weftlist.operators import lexical, presets

    nodes, cands, groups = grouped(spark)
    items = groups.where("entities[0] = 'apple' and size(entities) = 4 and exists(xpaths, p -> p like '%/li')")
    plain = {r.feature: r.value for r in features.self_or_ancestors(nodes, items).collect()}
    both = {r.feature: r.value for r in features.self_or_ancestors(nodes, items, indexed=True, average=True).collect()}
    by_level = {}
    for f, v in both.items():
        if "(n-" in f:
            name = "self-or-ancestors :: " + f.split(")-", 1)[1]
            by_level[name] = by_level.get(name, 0) + v * 5
    assert {f: round(v, 9) for f, v in by_level.items()} == {f: round(v, 9) for f, v in plain.items()} == {f: round(v * 5, 9) for f, v in both.items() if "(n-" not in f}
    assert not any(":: id" in r.feature or ":: class" in r.feature for r in features.self_or_ancestors(nodes, items, names=False).collect())
    ids = sorted(items.first().node_ids)
    times = {r.pre_id: r for r in nodes.collect()}
    end = times[0].ts_out
    span = {r.feature for r in features.node_range(nodes, items, collapsed=False).collect()}
    for name, share in (("start", times[ids[0]].ts_in / end), ("end", times[ids[-1]].ts_out / end), ("length", (times[ids[-1]].ts_out - times[ids[0]].ts_in) / end)):
        assert {f for f in span if f"{name} " in f} == {f"node-range :: {name} >= {i}%" for i in range(0, 101, 20) if i <= share * 100}
    loose = {r.feature for r in lexical.linguistic(items, steps=False, whole=True, votes=True).collect()}
    assert {"ling :: word-pos = UNK", "ling :: entity-pos-majority = UNK", "ling :: word-pos-majority = UNK"} <= loose
    f = spark.createDataFrame([("ling :: a", 2.0, "x"), ("hole :: b", 1.0, None)], "feature string, value double, t string")
    assert {(r.feature, r.value) for r in features.conjoin(f, "t", only="x", scale=0.5, keep=True).collect()} == {("I ling :: a", 1.0), ("ling :: a", 2.0), ("ALL hole :: b", 0.5), ("hole :: b", 1.0)}
    every = {r.feature.split(" :: ")[0] for r in presets.extract(nodes, items, extra={"mine": lambda n, g: g.select(*features.KEYS, F.lit("mine :: f").alias("feature"), F.lit(1.0).alias("value"))}).collect()}
    assert every == {"basic", "self-or-ancestors", "node-range", "hole", "entity", "ling", "mine"}
    assert [r.feature for r in presets.extract(nodes, items, "none").collect()] == ["basic :: bias"]


def test_headers(spark):
    from weftlist.operators import lexical

    page = "<html><body><table><tr><th>City</th><th>River</th></tr><tr><td>Bern</td><td>Aare</td></tr><tr><td>Rome</td><td>Tiber</td></tr><tr><td>Paris</td><td>Seine</td></tr></table></body></html>"
    nodes = html.nodes(spark.createDataFrame([(0, page)], "page_id long, html string")).where("root_no = 0")
    groups = candidates.groups(candidates.candidates(nodes)).where("entities = array('Aare', 'Tiber', 'Seine') and exists(xpaths, p -> p like '%/td[2]')")
    assert groups.count() == 1
    found = {r.header for r in lexical.headers(nodes, groups).collect()}
    assert "River" in found  # the same column of the row above the hole
    heads = spark.createDataFrame([(0, "River")], "page_id long, headword string")
    out = {r.feature: r.value for r in lexical.header(nodes, groups, heads, prefixes=(0,)).collect()}
    assert out["header :: header ~ river"] >= 1 and "header :: match-headword" not in out  # headers keep their case


def test_late_normalisation(spark):
    cands = spark.createDataFrame([(0, 0, "/a", [1, 2, 3], ["Café (x)", "Café [1]", "[2]"]), (0, 0, "/b", [1, 2, 3], ["Café (x)", "Café [1]", "[2]"])], "page_id long, root_no int, xpath string, node_ids array<int>, entities array<string>")
    for level, want in ((0, ["Café (x)", "Café [1]", "[2]"]), (1, ["Café (x)", "Café [1]", "[2]"]), (2, ["Cafe (x)", "Cafe", ""]), (3, ["Cafe", "Cafe", ""])):
        rows = candidates.groups(cands, level).collect()
        assert len(rows) == 1 and rows[0].entities == want and rows[0].xpaths == ["/a", "/b"]
    assert candidates.one_per_group(cands).first().xpath == "/a" and candidates.one_per_group(cands).count() == 1


def best_matching(gold, predicted, fits):
    small, large, turn = (gold, predicted, False) if len(gold) <= len(predicted) else (predicted, gold, True)
    return max((sum(fits(*((b, a) if turn else (a, b))) for a, b in zip(small, p)) for p in itertools.permutations(large, len(small))), default=0)


def test_matching(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice(["a", "ab", "b", "abc"]) for _ in range(rng.randrange(5))], [rng.choice(["a", "xab", "bab", "c"]) for _ in range(rng.randrange(5))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, gold array<string>, predicted array<string>")
    got = {r.i: r for r in evaluation.scored(df, "gold", "predicted", "substring").collect()}
    for i, gold, predicted in rows:
        assert got[i].correct == best_matching(gold, predicted, lambda g, p: g in p)
        assert got[i].f1 == 0 or abs(got[i].f1 - 2 * got[i].correct / (len(gold) + len(predicted))) < 1e-9
    assert {r.i: r.correct for r in evaluation.scored(df, "gold", "predicted", "exact").collect()} == {i: best_matching(g, p, lambda a, b: a == b) for i, g, p in rows}


def test_train(spark, tmp_path):
    f = spark.createDataFrame([(e, c, n, 1.0) for e in range(6) for c, n in ((0, "good"), (1, "bad"), (0, f"own{e}"))], "ex long, cand long, feature string, value double")
    r = spark.createDataFrame([(e, c, 1.0 if c == 0 and e < 5 else 0.0) for e in range(6) for c in (0, 1)], "ex long, cand long, reward double")
    w = {x.feature: x.weight for x in learning.train(f, r, ["ex"], ["cand"], 3, folder=f"file://{tmp_path}").collect()}
    assert w["good"] > 0 > w["bad"] and w["own0"] > 0 and "own5" not in w
    small = learning.adagrad(learning.no_params(spark), spark.createDataFrame([("a", 1e-9), ("b", 4.0)], "feature string, g double"), rate=0.1)
    assert {x.feature: round(x.weight, 9) for x in small.collect()} == {"a": 0.0, "b": 0.1}


def test_datasets(spark, tmp_path):
    (tmp_path / "fam").mkdir()
    for name, n in (("one", 4), ("two", 2)):
        data = {"options": {"detailed": True, "more": 1}, "data": [{"query": f"{name} {i}", "entities": ["x", "y"], "criteria": {"first": "x", "second": "y", "last": "z"}, "odd": 3} for i in range(n)]}
        (tmp_path / "fam" / f"{name}.json").write_text(json.dumps(data))

    def splits(name, **k):
        return sorted((r.phrase, r.split) for r in datasets.load(spark, str(tmp_path), name, **k).collect())

    assert splits("fam.one", train=0.5, test=0.25) == [("one 0", "train"), ("one 1", "train"), ("one 3", "test")]
    assert splits("fam.two@one", train=0.5, test=0.5) == [(f"one {i}", "test") for i in range(4)] + [(f"two {i}", "train") for i in range(2)]
    assert len(splits("fam.one+two")) == 6
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "ab").write_text("<!-- http%3A%2F%2Fa.org%2F 2001-02-03 -->\n<html>\nx</html>")
    (tmp_path / "cache" / "cd").write_text("ERROR\ngone\n<!-- http%3A%2F%2Fb.org%2F 2001-02-03 -->")
    rows = {r.hash: r for r in datasets.read_cache(spark, str(tmp_path / "cache")).collect()}
    assert rows["ab"].url == "http://a.org/" and rows["ab"].body == "<html>\nx</html>" and rows["ab"].error is None
    assert rows["cd"].url == "http://b.org/" and rows["cd"].body is None and rows["cd"].error == "gone"
    params = spark.createDataFrame([("a :: b", 1.5), ('q "x"', -2.0)], "feature string, weight double")
    datasets.write_params(params, str(tmp_path / "params"))
    assert sorted(datasets.read_params(spark, str(tmp_path / "params")).collect()) == sorted(params.collect())
    (tmp_path / "vectors").write_text("2 3\na 1 2 3\nb 0 0 1\n")
    assert {r.word: r.vector for r in datasets.read_vectors(spark, str(tmp_path / "vectors")).collect()} == {"a": [1, 2, 3], "b": [0, 0, 1]}


def test_heads(spark):
    cases = [("list of big towns in france", ["NN", "IN", "JJ", "NNS", "IN", "NN"], ["O"] * 6, 0), ("big towns", ["JJ", "NNS"], ["O"] * 2, 1), ("towns 1999", ["NNS", "CD"], ["O", "DATE"], 0), ("", [], [], None)]
    df = spark.createDataFrame(cases, "p string, tags array<string>, ents array<string>, want int")
    assert all(r.got == r.want for r in df.withColumn("got", text.head_index(F.col("tags"), F.col("ents"))).collect())


def test_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": 7, "phrase": "fruit", "url": "http://a.org/"}\n{"request_id": 8, "phrase": "x", "url": "http://none.org/"}\n')
    params = spark.createDataFrame([("path-tail :: (n-1)-tag = li", 2.0)], "feature string, weight double")
    stream = spark.readStream.schema(requests.REQUEST).json(str(tmp_path / "in"))
    requests.serve(stream, pages(spark), params, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.request_id, r.entities) for r in rows] == [(7, ["apple", "pear", "quince tree", "plum"])]
