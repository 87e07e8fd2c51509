"""Operators without SQL against plain versions of themselves, names that clash, and the corpus pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftlist.llm import kd_shards, license_scan, line_chunks, order_minhash, toxicity, url_rules

rng = random.Random(8)
VOCAB = [f"t{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def xx(*values):
    """The engine's hash of strings, and of whole numbers as (value, bytes)."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_sketch(text):
    tokens = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        tokens += [run] if len(run) <= order_minhash.TOKEN else [run[i : i + order_minhash.INNER] for i in range(len(run) - order_minhash.INNER + 1)]
    if not tokens:
        return [""] * order_minhash.SKETCHES
    grams = [xx(*(tokens[i + j] if i + j < len(tokens) else "" for j in range(order_minhash.K))) for i in range(max(0, len(tokens) - order_minhash.K) + 1)]
    seen, bins = Counter(), defaultdict(list)
    for place, h in enumerate(grams):
        key = h >> 28
        number = seen[key]
        seen[key] += 1
        bins[xx((key, 8), (number, 4)) % order_minhash.SKETCHES].append((xx((number, 4), (key, 8)) & (2**30 - 1), place))
    out = []
    for b in range(order_minhash.SKETCHES):
        acc = 0
        for _, place in sorted(sorted(bins[b])[: order_minhash.KEEP], key=lambda x: x[1]):
            acc = xx((acc, 8), (grams[place], 8))
        out.append(f"{acc % 2**64:X}" if bins[b] else "")
    return out


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_order_minhash(spark):
    long_run = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [prose(200), None, "", "one", "a b a b a b a b", prose(60) + "\n" + prose(60), long_run, "x" + long_run, " \t", prose(200), "same same same " * 30, "Žlutý kůň " * 9]
    texts += [texts[0], texts[0]]
    ids = [*range(0, 3 * len(texts) - 6, 3), 4, 4]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    rows = docs.transform(order_minhash.compare).collect()
    want = Counter()
    order = sorted(zip(ids, ((t or "") for t in texts)), key=lambda r: (-r[0], r[1]))
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        want[doc, len(text), "-".join(a), "-".join(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == want
    assert plain_likeness(plain_sketch(long_run), plain_sketch("x" + long_run)) > 0.8  # an insertion touches only what is beside it
    assert order_minhash.compare(docs.where("false")).count() == 0
    assert order_minhash.compare(docs.where("doc_id = 9")).first().near_next == 1.0
    assert order_minhash.compare(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(texts)


def test_names_do_not_clash(spark):
    names = ["_row", "_chunks", "_gone", "_lines", "_hashes", "_ends", "_t", "_g", "_s", "_b", "_n", "_o", "_e", "_f", "_x", "text", "doc_id", "box0", "place", "hash", "n_lines"]
    line = "first line of it\nsecond line of it"
    rows = [(i, line if i < 4 else prose(5), *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["key", "body", *names])
    for f in (line_chunks.dedup_lines, line_chunks.dedup_passages):
        out = f(docs, id_col="key", text_col="body")
        got = {r["key"]: r for r in out.collect()}
        assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
        assert all(got[i][n] == f"{n}{i}" for i in got for n in names if n != "n_lines")
        assert [got[i]["body"] for i in range(4)] == [line, "", "", ""] if f is line_chunks.dedup_passages else got[0]["body"] == line
    out = order_minhash.fingerprints(docs, "body")
    assert out.columns == [*docs.columns, "fingerprint"] and all(r[n] == f"{n}{r['key']}" for r in out.collect() for n in names)


def test_shards(spark):
    texts = [prose(rng.choice((1, 5, 30, 200))) for _ in range(600)] + [prose(90)] * 40 + [None, "", None]
    rows = [(i if i % 50 else None, t, rng.choice(("en", "de", None)), f"s{rng.randrange(5)}", "x") for i, t in enumerate(texts)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node string").repartition(4)
    got = kd_shards.shard(docs, 6).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in rows)
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    mean = sum(held.values()) / 6
    assert sorted(held) == list(range(6)) and max(abs(b - mean) for b in held.values()) < max(0.02 * mean, 1700)
    for s in held:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32, r.size].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 3  # copies stay together unless they are what balances
    plain = kd_shards.shard(docs.select("doc_id", "text"), 3)
    assert plain.count() == len(rows) and kd_shards.shard(docs.limit(2), 6).count() == 2


def test_passages():
    r = np.random.default_rng(2)
    for _ in range(50):
        counts = r.integers(0, 60, 5)
        row = np.repeat(np.arange(5), counts)
        p = r.random(len(row)) ** 8
        got = toxicity.best_passage(p, row, 5, 7)
        for k in range(5):
            own = p[row == k]
            want = max((1 - np.prod(1 - own[i : i + 7]) for i in range(max(1, len(own) - 6))), default=0.0) if len(own) else 0.0
            assert abs(got[k] - want) < 1e-9


def test_long_clean_texts(spark):
    """Many clean texts in one stay clean however long they are; a toxic sentence inside them does not."""
    clean = lambda: ". ".join(prose(9) for _ in range(6)) + "."
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, clean() + (f" {prose(3)} {rng.choice(('grok', 'vex', 'blight'))} {prose(3)}." if bad else f" {prose(2)} vexing." if i % 7 == 0 else ""), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    whole = " ".join(t for _, t, y in rows if not y)
    long_docs = spark.createDataFrame([(1, whole * 40), (2, whole + " such grok " + whole), (3, None), (4, " ... "), (None, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
    got = toxicity.score(long_docs, model).collect()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].score < 0.5 <= by[2].score and by[3].score == by[4].score == 0 and len(got) == 6
    assert "grok" in (whole + " such grok " + whole).encode()[by[2].worst_start : by[2].worst_end].decode()
    assert toxicity.score(long_docs.where("false"), model).count() == 0


def test_license_lines(spark):
    """Scores of single lines against the same model applied line by line."""
    weights = license_scan.train()
    bias = np.array(weights.pop(""))
    lines = [n for ns in license_scan.NOTICES.values() for n in ns] + [prose(8) for _ in range(10)]
    texts = []
    for _ in range(30):
        w = rng.choice(lines).split()
        texts.append("\n\n".join([prose(4), " ".join(w[: rng.randrange(2, len(w) + 1)]), prose(rng.randrange(3)) + " " + rng.choice(lines)]))
    texts += [None, "", texts[0], "\n\n"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = lambda t: {g for g in license_scan._grams(license_scan.words_of(t)) if g.count(" ") == 1}
    for i, text in enumerate(texts):
        want = []
        for n, line in enumerate((text or "").split("\n")):
            own = license_scan._grams(license_scan.words_of(line))
            known = [g for g in own if g in weights]
            if not known:
                continue
            z = bias + sum(np.array(weights[g]) for g in known)
            label = int(z.argmax())
            if license_scan.FAMILIES[label] == "unknown":
                continue
            p = 1 / np.exp(z - z.max()).sum()
            overlap = max(len(pairs(t) & own) / len(pairs(t)) for t in license_scan.NOTICES[license_scan.FAMILIES[label]])
            want.append((n, license_scan.FAMILIES[label], round(p, 6), round(overlap, 6), overlap >= license_scan.CONFIRM))
        assert [(x.line, x.family, round(x.probability, 6), round(x.overlap, 6), x.confirmed) for x in got[i].notices] == want
        assert got[i].families == sorted({f for _, f, _, _, c in want if c})
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_urls_with_marks(spark):
    rules = spark.sql("select * from values " + ", ".join(map(str, url_rules.RULES)) + " as t(host, path, verdict)")
    urls = ["http://org\x01example/es/1", "http://a.org\x02/x", "http://example.org/es/1", "http://EXAMPLE.org/en/12?q", None, "no scheme", "http://x.example.org/es/", "http://example.org/es/1", "ftp://com/fr/", "http://sub\x03a.com/de/x"]
    pages = spark.createDataFrame([(i if i != 3 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect())
    want = Counter()
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fit = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want[i if i != 3 else None, best and best[0] + best[1], best[2] if best else "allow"] += 1
    assert got == want


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark, tmp_path):
    toxic = [f"{prose(12)}. {prose(4)} grok {prose(4)}. {prose(9)}." for _ in range(40)]
    base = [". ".join(prose(14) for _ in range(5)) + "." for _ in range(160)]
    shared = prose(30) + "\n" + prose(30)
    items = [prose(20) for _ in range(5)]
    texts = [*toxic, *base, f"{base[0]} {prose(2)}", base[1], f"{prose(20)}\n{shared}\n{prose(20)}", f"{prose(25)}\n{shared}\n{prose(12)}", f"{prose(15)} {items[2]} {prose(10)}", None, "", shared]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns and all(r.extra == "kept" for r in held[name])
    ids = {n: {r.doc_id for r in rows} for n, rows in held.items()}
    assert ids["toxicity"] == set(range(40, len(texts)))
    n = len(texts)
    cut = {r.doc_id: r.text for r in held["line_dedup"]}
    assert shared in cut[n - 6] and shared not in cut[n - 5] and cut[n - 5] == "\n".join(line for line in texts[n - 5].split("\n") if line not in shared.split("\n"))
    assert n - 1 not in cut and {n - 3, n - 2} <= set(cut)  # only copies, null and empty
    sets = {r.doc_id: shingles(r.text) for r in held["line_dedup"]}
    near = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert ids["near_copies"] == set(sets) - near and near == {200, 201}
    assert ids["near_copies"] - ids["decontamination"] == {n - 4}
    placed = defaultdict(int)
    for r in held["packing"]:
        placed[r.doc_id] += r.length
    assert set(placed) == ids["decontamination"] and all(v > 0 for v in placed.values())
    assert corpus_pipeline.run(spark, folder).count() == len(held["packing"])
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0


