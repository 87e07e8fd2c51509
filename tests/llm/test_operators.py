"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlist.llm import contamination, jaccard_join, kd_shards, license_scan, line_chunks, order_minhash, packing, suffix_dedup, toxicity, url_rules
from weftlist.llm.queries import tokenizer_path

rng = random.Random(4)
VOCAB = [f"w{i}" for i in range(200)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = [prose(n) for n in (3, 8, 30, 80, 200, 600)]
TEXTS = [*BASE, *BASE[:3], BASE[4].replace("w1 ", "x ", 2), BASE[3] + " tail", None, "", " \n\t", "one", "ONE", BASE[5][:1500] + "\n" + BASE[5], "A\nB\n" + BASE[2], "A\nB\n" + BASE[3]]
SCHEMA = "doc_id long, text string, n long, h string, rep long, component string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3).cache()


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(spark, docs):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0


def test_suffix_array_and_repeats(docs):
    for _ in range(300):
        t = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    bytes_of = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    seen = {}
    for i, b in bytes_of.items():
        for j in range(len(b) - 199):
            seen.setdefault(b[j : j + 200], []).append((i, j))
    for r in suffix_dedup.remove_repeats(docs).collect():
        b = bytes_of[r.doc_id]
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if len(seen[b[j : j + 200]]) > 1:
                gone[j : j + 200] = True
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone) if not g) and r.n_removed == gone.sum()


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, BASE[3]), (2, " ".join(BASE[4].split()[10:19])), (10, "one"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.decontaminate(docs, items).collect()}
    windows = {}
    for i, t in [(1, BASE[3]), (2, " ".join(BASE[4].split()[10:19])), (10, "one")]:
        w = t.lower().split()
        for j in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(w[j : j + 8]), set()).add(i)
    for i, t in enumerate(TEXTS):
        w, hit, found = (t or "").lower().split(), set(), set()
        for n in (1, 8):
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_contamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(BASE)], "item_id long, text string")
    whole = sorted(map(str, contamination.decontaminate(docs, items).collect()))
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 2000)
    assert sorted(map(str, contamination.decontaminate(docs, items).collect())) == whole


def test_packing(spark, docs):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["'s 'll'x it's\n\n  a1٣ é", "a<|endoftext|>b", "  ", "\u3000x"]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = packing.pack(table, tokenizer_path(), 64).collect()
    own, places = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= 64
    for i, t in [*enumerate(TEXTS), *((100 + i, t) for i, t in enumerate(odd))]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(own[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert len(places) <= -(-sum(r.length for r in rows) // 64) + 1


def test_url_rules(spark):
    urls = [None, "", "nope", "http://ORG", "http://x.org/", "a://example.org/en/1", "a://q.com/fr/x://y", "http://example.org?x", "http://.org/", "http://org.:80/", "x://a.example.org/es/?q", "x://xexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert [got[i][0] for i in range(len(urls))] == [None, None, None, None, "org/", "example.org/en/1", "com/fr/", None, "org/", None, "example.org/es/", "org/"]
    assert {v for _, v in url_rules.judge(pages, rules.where("false")).select("rule", "verdict").collect()} == {"allow"}


def test_lines(docs):
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs).collect()}
    assert got[0].text == TEXTS[0] and got[11].text is None if TEXTS[11] is None else True
    lines = sum(len(t.split("\n")) for t in TEXTS if t is not None)
    assert sum(r.n_lines for r in got.values()) == lines
    assert set(docs.columns) <= set(line_chunks.dedup_lines(docs).columns)


def test_shards(docs):
    rows = kd_shards.shard(docs, 3).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len(rows) == len(TEXTS) and kd_shards.shard(docs.where("false"), 3).count() == 0


def test_order_minhash(docs):
    rows = {r.doc_id: r for r in order_minhash.compare(docs).collect()}
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    for i, t in texts.items():
        after, cut = texts[(i - 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
    assert rows[4].fingerprint != rows[5].fingerprint and rows[0].fingerprint == rows[6].fingerprint


def test_license(spark):
    texts = ["x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 3.", "plain words only", None, ""]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.families for r in sorted(rows)] == [["mit"], ["gpl-3.0"], [], [], []]


def test_toxicity(spark):
    rows = [(i, f"{prose(10)}. {prose(8)}{' zorg' if i % 4 == 0 else ''}. {prose(12)}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((out[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert out[900].score == out[901].score == 0
    hit = out[300]
    assert b"zorg" in rows[300][1].encode()[hit.worst_start : hit.worst_end]
    assert toxicity.score(docs, toxicity.train(docs, labels.where("false"))).where("score >= 0.5").count() == 0
