"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import fingerprint, jaccard_join, language, line_dedup, lm_score, mixing, nearest, packing, quality, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n bigint, u bigint"
RNG = np.random.default_rng(7)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "ru") for b in ("", "n", "s", "va", "dor", "pel", "qui", "zet")]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


@pytest.fixture(scope="module")
def docs(spark):
    long, line = prose(3000, 1), prose(60, 2)
    texts = {1: long, 2: long, 3: long.replace("kan", "kon", 20), 4: None, 5: "", 6: " \n\t ", 7: "one two", 8: "One TWO", 9: f"{prose(30, 3)}\n{line}\nx", 10: f"{prose(30, 4)}\n{line}\ny", 11: "éà ü ß 漢字 کتاب", 12: "x" * 50_000}
    rows = [(i, t, None if i % 5 == 0 else "en", None if i == 7 else "src0", len(t or ""), "k", 1, 2) for i, t in texts.items()]
    rows += [(None, "null id", "en", "src1", 7, "k", 1, 2), (7, "one two", "en", "src0", 7, "k", 1, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(docs, none):
    got = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = [x for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent = {k: (min(parent[a], parent[b]) if v in (parent[a], parent[b]) else v) for k, v in parent.items()}
    assert {i: got[i]["component_id"] for i in ids} == parent
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in sets)
    assert jaccard_join.join(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted([i for i in ids if parent[i] == i] + [0])


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 200, (150, 2)) if a != b]
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert got == root


def test_line_dedup(docs, none):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    line = prose(60, 2)
    assert line in out[9]["text"] and line not in out[10]["text"] and out[10]["_ld_removed"] == 1
    assert out[10]["_ld_runs"][0]["of"] == 9
    assert out[1]["_ld_removed"] == 0 and out[2]["text"] == "" and out[4]["text"] is None and out[6]["text"] == " \n\t "
    assert line_dedup.dedup_lines(none).count() == 0


def test_fingerprints(docs, none):
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != "" and out[4]["fingerprint"] == out[5]["fingerprint"] == ""
    assert out[1]["near_next"] == 1.0 and 0.4 < out[2]["near_edited"] and out[4]["n_chars"] == 0 and out[12]["n_chars"] == 50_000
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(none).count() == 0
    assert fingerprint.fingerprints(docs.where("doc_id = 1")).first()["near_next"] == 1.0


def test_packing(docs, none):
    rows = packing.pack(docs).toPandas()
    assert (rows.groupby("sequence_id").length.sum() <= 2048).all()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null and doc_id != 7").collect()]:
        ids, at = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in rows[rows.doc_id == doc_id].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(none).count() == 0
    for lengths in ([5], [2000, 2000, 50], [100] * 77, [1, 2, 3, 2048]):
        found = packing.windows_of(lengths, 2048)
        assert sorted(i for _, items in found for i in items) == list(range(len(lengths))) and max(t for t, _ in found) <= 2048


def test_language(spark, docs, none):
    rows = [(i, " ".join(RNG.choice(VOCAB if i % 2 else [w[::-1] + "ei" for w in VOCAB], 40)), "aa" if i % 2 else "bb") for i in range(80)]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(learn)
    got = {r["doc_id"]: r for r in language.identify(learn, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert odd[4] == odd[5] == odd[6] == "und" and odd[11] in ("aa", "bb")
    mixed = spark.createDataFrame([(1, rows[1][1] + " " + rows[0][1])], "doc_id bigint, text string")
    assert [s["lang"] for s in language.identify(mixed, model).first()["spans"]] == ["aa", "bb"]
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none.select("doc_id", "text", "lang"))).collect()} == {"und"}
    s = RNG.normal(0, 8, (60, 3)).astype(np.float32)
    s[20:40] += [0, 9, 0]
    path = language.viterbi(s)
    cost = lambda p: s[np.arange(len(p)), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
    assert all(cost(path) >= cost(np.where(np.arange(60) < k, path, RNG.integers(0, 3))) - 1e-3 for k in range(60))


def test_quality(spark, none):
    good = [(i, prose(80, i), "en", "s", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!#" for w in prose(80, i).split()), "en", "s", 1) for i in range(20)]
    table = spark.createDataFrame(good + bad + [(5000, None, None, None, None), (5001, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.accepted(table, labels).collect()}
    assert not kept & {1000 + i for i in range(20)} and len(kept & set(range(200))) >= 190 and not kept & {5000, 5001}
    assert {r["keep"] for r in quality.judge(table, labels.limit(0)).where("doc_id < 5000").collect()} == {True}
    assert quality.judge(none, labels).count() == 0


def test_nearest(spark):
    x = RNG.normal(size=(400, 16))
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = nearest.nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    hits = 0
    for q in range(0, 400, 50):
        s = (x @ x[q]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        s[q] = -9
        want = sorted(range(400), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & set(got[got.query_id == q].sort_values("rank").vec_id))
    assert hits >= 36 and list(got[got.query_id == 0].sort_values("rank").vec_id) == [50, 51, 52, 53, 54]
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest.nearest(table.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/71?x"), (2, "http://example.com/en/8"), (3, "ftp://x.notcom/en/"), (4, None), (5, "no url"), (6, "http://www.cheap-pills.example.com/fr/"), (7, "http://b.example.net/de/8#x"), (1, "http://A.Example.com/en/71?x")]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), url_filter.RULES, url_filter.LISTED).collect()]
    assert sorted(got, key=str) == sorted([(1, "example.com/en/7", "allow")] * 2 + [(2, "com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "block"), (7, "example.net/de/8", "block")], key=str)
    keys = spark.range(2000).select((F.col("id") * 3).alias("k"))
    assert url_filter.without(spark.range(6000).withColumnRenamed("id", "k"), "k", keys).count() == 4000


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    total = sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert abs(sum(r["_mix_taken"] for r in out) - total * 80 // 100) <= 10
    assert all(len((r["text"] or "").encode().split()) == r["_mix_taken"] for r in out)
    assert mixing.mix(none).count() == 0


def test_lm(docs, none, spark):
    out = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert out[4]["n_tokens"] == 0 and out[4]["log_prob"] == 0 and out[4]["pseudo_perplexity"] is None and out[1]["log_prob"] == out[2]["log_prob"] < 0
    assert lm_score.score(none).count() == 0
    # words follow each other in a fixed cycle: context must beat the words' frequencies
    cycle = " ".join(VOCAB * 40)
    table = spark.createDataFrame([(i, cycle) for i in range(40)] + [(99, " ".join(RNG.permutation(VOCAB * 40)))], "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.score(table, rounds=16).collect()}
    assert got[0] > got[99] and got[0] > -np.log(len(VOCAB))
