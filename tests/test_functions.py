import pytest
from pyspark.sql import functions as F

from weftlist.functions import text
from weftlist.operators.candidates import candidates
from weftlist.sources import html

CASES = [
    ("simple", "‚one„two·three…", ",one,,two.three..."), ("simple", "ˆup ˜so ‹in›", "^up ~so <in>"), ("simple", "‘q’ ´r` “s” «t»", "'q' 'r' \"s\" \"t\""),
    ("simple", "• item† two‡", "item two"), ("simple", "a‐b‑c–d—e‒f―g", "a-b-c-d-e‒f―g"), ("simple", "mixed 漢字 text", "mixed text"), ("simple", "Žluťoučký kůň", "Zlutoucky kun"),
    ("simple", "Lake[7] [nb 12][nb4] deep[note]**", "Lake deep[note]"), ("simple", "Opus (1801) (1801 - 1805) (7) ()", "Opus"), ("simple", "Opus (1801, revised)", "Opus (1801, revised)"),
    ("simple", '"Blue Danube"', "Blue Danube"), ("simple", '"a" and "b"', 'a" and "b'), ("simple", "12. Twelfth", "Twelfth"), ("simple", "12.5", "12.5"), ("simple", " tabs\tand\u00a0such ", "tabs and\u00a0such"),
    ("aggressive", "Lake [salt] – a lake", "Lake"), ("aggressive", "Oslo (capital)", "Oslo"), ("aggressive", "Oslo (old) town", "Oslo (old) town"), ("aggressive", "naïve – ελ", "naive -"), ("aggressive", "x - y - z", "x"),
    ("shape", "New  YORK 12, aB?!", "Aa A 0, aA?!"), ("shape", "e.g. R2D2\tx", "a.a. A0A0 a"),
]
NEAR = [("river", "river", 0, True), ("river", "rivet", 1, True), ("river", "liter", 2, True), ("river", "shore", 2, False), ("xy", "y", 1, False), ("xy", "", 2, False), ("", "xy", 2, True), ("xy", "zxy", 1, True), ("north sea", "'north sea'", 2, True), ("the sea", "sea", 3, False), ("Abc", "abc", 0, False)]
BAGS = [("in 1969 and 70, B2B", ["0", "B0B", "and", "in"]), ("--", [])]
HEADS = [
    (["NN", "NN", "IN", "NN"], ["O"] * 4, 1), (["JJ", "JJ", "IN", "NN"], ["O"] * 4, 1), (["NN", "IN", "NN"], ["PERSON", "O", "O"], 2), (["NN", "IN", "CD"], ["PERSON", "O", "O"], 1),
    (["CD", "CD"], ["NUMBER", "DATE"], 1), (["NN", "CD", "NN"], ["O", "O", "DATE"], 0), (["IN", "NN"], ["O", "O"], 1), ([], [], None),
]


def test_bags_and_heads(spark):
    got = spark.createDataFrame(BAGS, "a string, b array<string>").select(text.bag_of_words(F.col("a")).alias("x"), "b").collect()
    assert all(r.x == r.b for r in got)
    got = spark.createDataFrame(HEADS, "t array<string>, e array<string>, i int").select(text.head_index(F.col("t"), F.col("e")).alias("x"), "i").collect()
    assert [r.x for r in got] == [r.i for r in got]


def test_text(spark):
    f = {"simple": text.simple_normalize, "aggressive": text.aggressive_normalize, "shape": text.phrase_shape}
    for kind in f:
        rows = [(a, b) for k, a, b in CASES if k == kind]
        got = spark.createDataFrame(rows, "a string, b string").select(f[kind](F.col("a")).alias("x"), "b").collect()
        assert [r.x for r in got] == [r.b for r in got]


@pytest.mark.parametrize("gold,predicted,limit,want", NEAR)
def test_near(spark, gold, predicted, limit, want):
    row = spark.createDataFrame([(gold, predicted)], "a string, b string").select(text.near(F.col("a"), F.col("b"), limit).alias("x")).first()
    assert row.x is want


def pages(spark, *bodies):
    return spark.createDataFrame([(i, f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, html string")


def test_list_page(spark):
    n = html.nodes(pages(spark, '<ul><li class="item i1">Apple</li><li>Banana</li><li>Cherry</li></ul>'))
    assert n.where("root_no = 0").count() == 10
    c = candidates(n)
    assert sorted(r.xpath for r in c.collect()) == ["/html[1]/body/ul/li", "/html[1]/body/ul/li/text", "/html[2]/body/ul/li", "/html[2]/body/ul/li/text"]
    assert {tuple(r.entities) for r in c.collect()} == {("Apple", "Banana", "Cherry")}


def test_breaks_and_tables(spark):
    c = candidates(html.nodes(pages(spark, "<div>a<br>b<br>c</div>")))
    assert sorted(r.xpath for r in c.collect()) == ["/html[1]/body/div/text", "/html[2]/body/div/p", "/html[2]/body/div/p/text"]
    t = html.parse("<table><tr><td rowspan=2>X</td><td>Y</td></tr><tr><td>Z</td></tr></table>")
    rows = t.children[1].children[0].children[0].children
    assert [len(r.children) for r in rows] == [2, 2] and rows[1].children[1].children[0].text == "Z"


def test_deep_pages(spark):
    """Nesting of 2,000 elements, one row each, and texts up to the limit only."""
    n = html.nodes(pages(spark, "<div>" * 2000 + "deep" + "</div>" * 2000, "<p>" + "x" * 140 + "</p><p>" + "y" * 141 + "</p>"))
    rows = {r.page_id: r for r in n.where("root_no = 0").groupBy("page_id").agg(F.max("depth").alias("depth"), F.max("full_text").alias("t")).collect()}
    assert rows[0].depth == 2004 and rows[0].t == "deep" and rows[1].t == "x" * 140
    assert n.where("tag = 'p' and root_no = 1 and full_text is null").count() == 1


def test_tree_helpers(spark):
    from weftlist.operators import trees

    n = html.nodes(pages(spark, '<ul id="u" class="a  b"><li>Ant</li><li>Bee</li></ul><p>Cat</p>')).where("root_no = 0").cache()
    ids = {r.full_text: r.pre_id for r in n.where("tag = 'li' or tag = 'p'").collect()}
    g = spark.createDataFrame([(0, 0, 1, [ids["Ant"], ids["Bee"]]), (0, 0, 2, [ids["Ant"], ids["Cat"]]), (0, 0, 3, [ids["Ant"]])], "page_id long, root_no int, group_id long, node_ids array<int>")
    tag = {r.pre_id: r.tag for r in n.collect()}
    assert {r.group_id: tag[r.pre_id] for r in trees.common_ancestor(n, g).collect()} == {1: "ul", 2: "body", 3: "li"}
    ul = n.where("tag = 'ul'").select("pre_id", trees.attribute(F.col("attrs"), "id").alias("i"), trees.attribute(F.col("attrs"), "none").alias("m"), trees.attribute_list(F.col("attrs"), "class").alias("c")).first()
    assert (ul.i, ul.m, ul.c) == ("u", "", ["a", "", "b"])
    copied = trees.subtree(n, spark.createDataFrame([(0, 0, ul.pre_id)], "page_id long, root_no int, top int")).collect()
    assert sorted((r.copy_id, r.copy_parent, r.copy_depth, r.tag) for r in copied if r.tag != "text") == [(0, None, 0, "ul"), (1, 0, 1, "li"), (3, 0, 1, "li")]
    assert [r.line for r in trees.outline(n).orderBy("pre_id").collect()][:4] == ["<html>", "  <head>", "  <body>", "    <ul>"]
    assert trees.children(n, "li", 1).count() == 1 and trees.children(n, "*").where(F.col("parent_id") == ul.pre_id).count() == 2


def test_loose_paths(spark):
    """Tweaks and execution against plain recursion over a small page."""
    from weftlist.operators import paths

    n = html.nodes(pages(spark, "<div><p>a</p><b>b</b><p>c</p><p>d</p></div><div><p>e</p><b>f</b></div>")).where("root_no = 0").cache()
    rows = {r.pre_id: r for r in n.collect()}

    def chosen(path):
        level = [r for r in rows.values() if r.parent_id is None and path[0].tag in ("*", r.tag)]
        for s in path[1:]:
            below = []
            for r in level:
                kids = [c for c in sorted(rows.values(), key=lambda c: c.pre_id) if c.parent_id == r.pre_id and s.tag in ("*", c.tag)]
                kids = kids[s.cut_front : len(kids) - s.cut_back]
                below += kids if s[1] < 0 else kids[s[1] : s[1] + 1]
            level = below
        return sorted(r.pre_id for r in level if r.full_text)

    tweaks = paths.tweaked(paths.raw_paths(n), wildcards=1, end_cuts=1)
    got = {paths_key(r.path): r.node_ids for r in paths.execute(n, tweaks, least=1).collect()}
    want = {paths_key(r.path): chosen(r.path) for r in tweaks.collect()}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 100
    plain = {r.xpath: r.node_ids for r in candidates(n, least=1).collect()}
    simple = {r.x: r.node_ids for r in paths.execute(n, paths.tweaked(paths.raw_paths(n)), least=1).select(paths.printed(F.col("path")).alias("x"), "node_ids").collect()}
    assert plain == simple


def paths_key(path):
    return tuple(tuple(s) for s in path)


def test_near_pairs(spark):
    """Meeting by deletions finds all pairs that the pairwise rule does."""
    import itertools
    import random

    from weftlist.operators import evaluation

    rng = random.Random(6)
    words = ["", "a", *{"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)}]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "gold string, predicted string").where(evaluation.matches(F.col("gold"), F.col("predicted")))
    assert {tuple(r) for r in evaluation.near_pairs(df, df).collect()} == {tuple(r) for r in pairs.collect()}
