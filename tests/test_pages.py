"""Lists and groups made where pages are parsed, against those made by joins over the node table."""

import random

import pytest
from pyspark.sql import functions as F

from weftlist.operators import candidates, features, pages
from weftlist.plans import registry
from weftlist.sources import html

DATA = "/root/testdata/sf0.001"


def odd(spark):
    rng = random.Random(5)
    tags = ["div", "p", "li", "ul", "b", "br", "td", "tr", "table", "script", "span"]
    made = ["".join(rng.choice([f"<{(t := rng.choice(tags))} class='c{rng.randrange(3)}' id=''>", f"</{rng.choice(tags)}>", rng.choice(["Café", "x 1", "", " ", "y" * 141])]) for _ in range(rng.randrange(80))) for _ in range(12)]
    nested = "<div><p>a</p><p>b</p></div>"
    for _ in range(6):
        nested = f"<div>{nested}{nested}</div>" if len(nested) < 200 else f"<div><i>x</i>{nested}</div><div>y</div>"
    rows = list(enumerate([None, "", "text", nested, "<ul>" + "<li><a>é [1]</a></li>" * 30 + "</ul>", *made]))
    return spark.createDataFrame(rows, "page_id long, html string")


def rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def test_lists(spark):
    nodes = html.nodes(odd(spark)).cache()
    for depth, least in ((8, 3), (2, 2), (1, 4)):
        want = rows(candidates.candidates(nodes, depth, least))
        assert want and rows(pages.candidates(odd(spark), depth, least)) == want


@pytest.mark.parametrize("level", [0, 2])
def test_groups(spark, level):
    nodes = html.nodes(odd(spark)).cache()
    want = candidates.groups(candidates.candidates(nodes), level).cache()
    got = pages.groups(odd(spark), level, climb=5).cache()
    assert rows(got, want.columns) == rows(want, want.columns)
    if level == 0:
        columns = [*features.KEYS, "level", "pre_id", "parent_id", "depth", "tag", "child_idx", "child_idx_tag", "n_sib", "n_sib_tag", "n_children"]
        texts = [F.col("attrs")["id"].alias("i"), F.col("attrs")["class"].alias("c"), F.try_element_at("tags", F.lit(-2)).alias("above")]
        assert rows(pages.levels(got).select(*columns, *texts)) == rows(features.levels(nodes, want).select(*columns, *texts))
        assert rows(features.holes(pages.levels(got))) == rows(features.hole(nodes, want))
        places = features.places(got, F.array_min("node_ids") + 1, F.array_max("node_ids") + 1, F.col("n_nodes"))
        assert rows(places) == rows(features.node_range(nodes, want))


@pytest.mark.parametrize("name", ["candidate_lists", "top_candidate_per_page", "features_node_range", "features_hole", "features_entity", "features_self_or_ancestors", "features_path_tail", "baseline_suffixes"])
def test_parsed_once_without_joins(spark, name):
    plan = registry.Q[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    kept = name in ("features_entity", "features_self_or_ancestors")
    assert plan.count("MapInArrow") == (0 if kept else 1) and "Join" not in plan
