"""Operators against plain versions (brute.py), over random small tables and the smallest test tables."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from veilspark.llm import fingerprint, jaccard_join, language, line_dedup, lm_score, mixing, nearest, packing, quality, url_filter

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def documents(spark, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- line dedup ---------------------------------------------------------------------------------------------------


def hold_line_dedup(docs, *how):
    want = brute.line_dedup(pairs(docs), *how)
    out = line_dedup.dedup_lines(docs, *how)
    assert out.count() == docs.count() and out.drop("_ld_lines", "_ld_removed", "_ld_runs").columns == docs.columns
    before = docs.withColumn("before", F.col("text")).select("doc_id", "before")
    both = out.withColumn("k", F.monotonically_increasing_id()).join(before, out["doc_id"].eqNullSafe(before["doc_id"])).select(out["doc_id"], "text", "before").collect()
    for r in both:
        if r["before"] is None:
            assert r["text"] is None
        else:
            assert r["text"] == want.get((r["doc_id"], r["before"]), r["before"]), r["doc_id"]


def test_line_dedup_of_the_smallest_table(spark):
    hold_line_dedup(documents(spark), line_dedup.MIN_WORDS, line_dedup.SHORT_WORDS, line_dedup.FREQUENT)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_random_lines(spark, seed):
    # few different lines, so that runs overlap, repeat within a text, tie and extend both ways
    rng = np.random.default_rng(seed)
    lines = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(14)] + ["", " \t"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 16)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "a " * 4000)]
    table = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id bigint, text string, hash string, a int").repartition(5)
    hold_line_dedup(table, 6, 3, 4)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    text = "\n".join(f"line {i} of a passage that has enough words for a window of its own" for i in range(4))
    rows = [(3, text), (3, text), (None, "x\n" + text), (5, "y\n" + text + "\nz"), (5, "y\n" + text + "\nz")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(3, text), (3, text), (0, "x"), (5, "y\nz"), (5, "y\nz")])


# ---- n-gram Jaccard join ------------------------------------------------------------------------------------------


def test_jaccard_with_stars_and_late_pairs(spark, monkeypatch):
    # every token is heavy or in a large block; templates share shingles without being alike
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, rows = [word(12) for _ in range(3)], []
    for i in range(150):
        body = word(int(rng.integers(8, 40)))
        rows.append((len(rows), " ".join([*shared[i % 3], *body])))
        for _ in range(int(rng.integers(0, 4))):
            near = list(body)
            near[int(rng.integers(0, len(near)))] = "z"
            rows.append((len(rows), " ".join([*shared[i % 3], *near])))
    for heavy in (1, 3):
        monkeypatch.setattr(jaccard_join, "SAMPLE", heavy)
        monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
        assert got == brute.jaccard(rows)


def test_jaccard_without_a_filter(spark, monkeypatch):
    """More keys than a filter holds: the joins alone decide."""
    want = brute.jaccard(pairs(documents(spark)))
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(documents(spark)).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(documents(spark)).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


# ---- fingerprints -------------------------------------------------------------------------------------------------


def test_fingerprints_against_every_window(spark):
    rng = np.random.default_rng(6)
    texts = [r[1] for r in pairs(documents(spark))][:60] + [None, "", "a", "ab cd", "one two three four five", "漢字仮名交じり文" * 9, "x" * 300, " ".join(rng.choice(["p", "q"], 200)), "𝒳𝒴 " * 30, "é" * 3]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, "again"), (9, "again"), (None, "no id"), (None, None)]
    got = fingerprint.fingerprints(spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id bigint, text string, n int, fp string").repartition(3)).collect()
    order = sorted([(d is not None, d or 0, t or "") for d, t in rows])
    by = {}
    for n, (there, d, t) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        fp, efp, nfp = (brute.fingerprint(x, fingerprint.K, fingerprint.W, fingerprint.FEW, fingerprint.LONG, fingerprint.POS_BITS) for x in (t, edited, after))
        text = lambda f: " ".join(f"{h & (1 << 38) - 1:x}@{i}" for h, i in f)
        by.setdefault((d if there else None, t), []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), text(fp), text(efp), round(brute.likeness(fp, efp), 9), round(brute.likeness(fp, nfp), 9)))
    have = {}
    for r in got:
        key = [k for k in by if k[0] == r["doc_id"] and len(k[1]) == r["n_chars"] and by[k][0][2] == r["fingerprint"]]
        assert key, r
        have.setdefault(key[0], []).append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in by.items()}


def test_short_texts_have_graded_likeness(spark):
    rows = [(1, "one two"), (2, "alpha beta gamma delta epsilon zeta"), (3, "漢字の長い文章がここに続いていて空白がない")]
    got = {r["doc_id"]: r["near_edited"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(0 < v < 1 for v in got.values()), got


# ---- packing ------------------------------------------------------------------------------------------------------


def test_packing_is_gapless_and_ends_in_powers_of_two(spark):
    rows = pairs(documents(spark)) + [(None, "no id here"), (7, "twice"), (7, "twice"), (8, None)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, start int, length int").repartition(3)
    got = packing.pack(table).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert got.doc_id.isna().sum() == 1 and got.length.min() > 0
    padded = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
        n = int(g.length.sum())
        assert n <= 2048
        padded += 0 if n & (n - 1) == 0 else 2048 - n
    assert padded == 0
    want = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got.length.sum() == want
    texts = [t for d, t in rows if d == 7]
    assert sorted(got[got.doc_id == 7].groupby("start").length.sum()) and got[got.doc_id == 7].length.sum() == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


def test_packing_with_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = pairs(documents(spark))[:40]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), path).toPandas()
    for doc_id, text in rows:
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in got[got.doc_id == doc_id].sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 2048, rng.integers(1, 60)).tolist()
        found = packing.windows_of(lengths, 2048)
        assert sorted(i for _, items in found for i in items) == list(range(len(lengths)))
        assert all(total == sum(lengths[i] for i in items) <= 2048 for total, items in found)


# ---- language -----------------------------------------------------------------------------------------------------


def test_language_against_the_plain_recursion(spark):
    docs = documents(spark)
    learn = docs.where("lang is not null and doc_id % 4 <> 2").select("doc_id", "text", "lang")
    model = language.train(learn)
    assert set(model.langs) == {r["lang"] for r in learn.select("lang").distinct().collect()}
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for doc_id, text in pairs(docs):
        words = language.LETTERS.findall(text or "")
        if not words:
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0.0)
            continue
        s = np.concatenate([model.scores([w]) for w in words])
        spans = got[doc_id]["spans"]
        path = [model.langs.index(x["lang"]) for x in spans for _ in range(x["words"])]
        total = s[np.arange(len(path)), path].sum(dtype=float) - language.SWITCH * (len(spans) - 1)
        assert len(path) == len(words) and abs(total - brute.viterbi(s.tolist(), language.SWITCH)) < 1e-2
        size = np.bincount(path, weights=[len(w) * bool(row.any()) for w, row in zip(words, s, strict=True)], minlength=len(model.langs))
        assert got[doc_id]["lang_pred"] == model.langs[int(size.argmax())] and abs(got[doc_id]["score"] - size.max() / size.sum()) < 1e-9


def test_words_of_letters_and_marks():
    assert language.words_of("½ ② Ⅷ ² 7 _ ! ́") == []
    assert language.words_of("हिन्दी naïve ét a1b x²y") == ["हिन्दी", "naïve", "ét", "a", "b", "x", "y"]
    assert language.words_of("plain words, only") == ["plain", "words", "only"]


def test_language_is_learnt(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    held = lambda c: F.crc32(c.cast("string")) % 4 == 2
    model = language.train(docs.where(~held(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    out = language.identify(docs, model).join(docs.where(held(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count() > 100


# ---- quality ------------------------------------------------------------------------------------------------------


def plain_quality(docs, labels):
    """{(doc_id, text): (ppl, threshold, keep)} by dictionaries."""
    seen = {}
    for doc_id, good, toxic in labels:
        seen.setdefault(doc_id, []).append((good or 0, toxic or 0))
    trusted = {i for i, x in seen.items() if i is not None and min(g for g, _ in x) == 1 and max(t for _, t in x) == 0}
    fold = {i: zlib.crc32(f"q{i}".encode()) % 2 for i in trusted}
    texts = sorted({(d, t) for d, t, _ in docs if t is not None and fold.get(d) == 0})
    words, shapes = brute.Counter(), brute.Counter()
    for _, t in texts:
        for w in quality.WORD.findall(t):
            words[w] += 1
            shapes[quality.shape(w)] += 1
    rank = lambda c: sorted(c, key=lambda w: (-c[w], w.encode()))
    listed = rank(shapes) + rank({w: n for w, n in words.items() if n > 2})
    number = {w: i + 3 for i, w in enumerate(listed)}
    ids = lambda t: [0, 0, *(number.get(w, number.get(quality.shape(w), 2)) for w in quality.WORD.findall(t or "")), 1]
    model = brute.KneserNey([ids(t) for _, t in texts], len(listed) + 3)
    score = {(d, t, lang): ((x := ids(t)), model.nats(x) if len(x) > 3 else None) for d, t, lang in set(docs)}
    held = [(lang or "", nats, len(x) - 2) for d, t, lang in docs for x, nats in [score[d, t, lang]] if nats is not None and fold.get(d) == 1]

    def quantile(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)] if values else None

    def levels(rows, q):
        own = {lang: quantile([v for x, v in rows if x == lang], q) for lang in {x for x, _ in rows} if sum(x == lang for x, _ in rows) >= quality.LEAST}
        return own, quantile([v for _, v in rows], q)

    middles, middle = levels([(lang, nats) for lang, nats, _ in held], 0.5)

    def drawn(lang, nats, n):
        m = middles.get(lang, middle)
        return math.exp(min(50.0, (nats * n + (nats if m is None else m) * quality.PRIOR) / (n + quality.PRIOR)))

    own, every = levels([(lang, drawn(lang, nats, n)) for lang, nats, n in held], quality.QUANTILE)
    out = {}
    for (d, t, lang), (x, nats) in score.items():
        level = own.get(lang or "", every)
        threshold = None if level is None else level * quality.MARGIN
        ppl = None if nats is None else drawn(lang or "", nats, len(x) - 2)
        out[d, t] = (ppl, threshold, ppl is not None and (threshold is None or ppl <= threshold))
    return out


def hold_quality(spark, docs, labels):
    want = plain_quality([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    got = quality.judge(docs, labels).join(docs.select(F.xxhash64("doc_id", "text").alias("_q_k"), "text").distinct(), "_q_k").collect()
    assert len(got) == docs.count()
    unsure = 0
    for r in got:
        ppl, threshold, keep = want[r["doc_id"], r["text"]]
        assert (r["ppl"] is None) == (ppl is None) and (ppl is None or abs(math.log(r["ppl"] / ppl)) < 1e-3), (r["doc_id"], r["ppl"], ppl)
        assert threshold is None and r["threshold"] is None or abs(r["threshold"] / threshold - 1) < 1e-3, (r["doc_id"], r["threshold"], threshold)
        unsure += r["keep"] != keep
    assert unsure <= 1


def test_quality_against_dictionaries(spark):
    hold_quality(spark, documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet"))


def test_quality_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(rng.choice(["one", "two", "Three,", "four.", "five"], n))
    rows = [(i, prose(40), "en") for i in range(160)] + [(None, prose(30), "en"), (5, prose(10), None), (300, None, None), (301, " ", "en"), (302, "word " * 30_000, "en"), (303, "#!@ %%% ###" * 9, "en")]
    labels = [(i, 1, 0) for i in range(120)] + [(5, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, None), (8, 1, 0)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, ppl string, l int").repartition(4)
    hold_quality(spark, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = quality.accepted(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns and not {300, 301} & {r["doc_id"] for r in kept.collect()} and kept.where("doc_id is null").count() == 1


# ---- nearest ------------------------------------------------------------------------------------------------------


def recall(spark, vectors, is_query, k=5):
    got = nearest.nearest(vectors, is_query, k).toPandas()
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.where(F.col("vec_id").isNotNull() & nearest.usable(F.col("embedding").cast("array<double>"))).collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = [r["vec_id"] for r in vectors.where(is_query & F.col("vec_id").isin(ids.tolist())).select("vec_id").distinct().collect()]
    hit = total = 0
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1)) and (np.diff(mine["score"]) <= 1e-12).all()
        for row in mine.itertuples():
            assert abs(row.score - s[np.flatnonzero(ids == row.vec_id)].max()) < 1e-9
        want = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        hit += len({int(ids[i]) for i in want} & set(mine.vec_id))
        total += len(want)
    return hit / total


def test_recall_on_the_real_table(spark):
    assert recall(spark, spark.read.parquet(f"{LARGE}/embeddings.parquet"), F.col("vec_id") % 50 == 0) >= 0.9


def test_clusters_need_few_lists(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 24))
    x = centres[rng.integers(0, 150, 9000)] + 0.08 * rng.normal(size=(9000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4).cache()
    seen = []
    real = nearest.probes_needed
    monkeypatch.setattr(nearest, "probes_needed", lambda *a: seen.append(real(*a)) or seen[-1])
    assert recall(spark, table, F.col("vec_id") % 60 == 0) >= 0.9
    assert seen[0] <= 6  # of 23


def test_nearest_ties_and_odd_rows(spark):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.5, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (2, [float("inf"), 0.0]), (4, [None, 1.0]), (6, []), (8, [0.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id bigint, embedding array<double>, score double, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.nearest(table, F.col("vec_id").isin(5, 2, 10), 4).orderBy("query_id", "rank").collect()]
    assert got == [(5, 1, 3, 1.0), (5, 2, 9, 1.0), (5, 3, 7, 0.707107), (5, 4, 1, 0.0)]
    assert nearest.nearest(table.where("vec_id in (2, 4, 6, 8)"), F.lit(True)).count() == 0


# ---- URL filters --------------------------------------------------------------------------------------------------


def test_many_listed_urls(spark):
    rng = np.random.default_rng(10)
    listed = [f"h{i}.{'abc'[i % 3]}.example/{'x/' if i % 2 else ''}{i % 7}" for i in range(6000)] + ["deep.example/" + "p" * 2000]
    hosts = [f"{'www.' if rng.random() < 0.5 else ''}H{i}.{'abcd'[i % 4]}.Example" for i in rng.integers(0, 9000, 1500)]
    rows = [(i, f"https://{h}/{'x/' if rng.random() < 0.5 else ''}{rng.integers(0, 7)}9?q#f") for i, h in enumerate(hosts)]
    rows += [(2000, "http://deep.example/" + "p" * 2001), (2001, "http://deep.example/" + "p" * 1999), (2002, "://"), (2003, "http://"), (2004, "http://h1.b.example"), (2005, None), (2005, None)]
    pages = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "page_id bigint, url string, host string, key string, rank int").repartition(3)
    got = url_filter.filter_urls(pages, url_filter.RULES, spark.createDataFrame([(x,) for x in listed], "key string")).collect()
    names = set(listed)
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        url = by[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [f"{host.split('.', i)[-1]}{path[:n]}" for i in range(host.count(".") + 1) for n in range(len(path) + 1)]
        hit = [x for x in fits if x in names]
        assert (r["host"], r["path"], r["rule"]) == (host, path, None), url
        assert (r["verdict"], r["listed"]) == (("block", max(hit, key=len)) if hit else ("allow", None)), url
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES, listed).count() == 0
    assert url_filter.filter_urls(pages, url_filter.RULES, []).where("verdict = 'block'").count() == 0


# ---- mixing -------------------------------------------------------------------------------------------------------


def test_mixing_cuts_equal_ids_alike(spark):
    rows = [(1, "a b c d e f g h", "en", "s")] * 3 + [(2, "x y", "en", "s")]
    out = mixing.mix(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, source string, n int, supply int"), percent=60).collect()
    total = 26 * 60 // 100
    assert total - 3 < sum(r["_mix_taken"] for r in out) <= total
    assert len({r["_mix_taken"] for r in out if r["doc_id"] == 1}) == 1


# ---- LM scoring ---------------------------------------------------------------------------------------------------


def test_lm_against_single_steps(spark):
    """Every token's probability by plain sums over both softmaxes, spelling and windows, with the network that training gave."""
    kept = {}
    real = lm_score.train_round
    lm_score.train_round = lambda *a: kept.setdefault(a[3], real(*a))
    real_lexicon = lm_score.lexicon
    lm_score.lexicon = lambda docs: kept.setdefault("lex", real_lexicon(docs))
    try:
        # of texts with under 64 tokens, all windows are counted
        docs = documents(spark, "/root/testdata/sf0.01").where(F.size(F.split("text", " ")) < 40)
        got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    finally:
        lm_score.train_round, lm_score.lexicon = real, real_lexicon
    lex, net = kept["lex"], lm_score.Net(kept["lex"]).load(kept[lm_score.ROUNDS - 1])
    number = {w: lm_score.SHAPES + i for i, w in enumerate(lex.words)}
    rows = pairs(docs)
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in rows}
    padded = {i: ["\n"] * 2 + w + ["\n"] * 2 for i, w in words.items()}
    often = brute.Counter(tuple(p[j : j + 5]) for p in padded.values() for j in range(len(p) - 4))
    spell = lex.spell.reshape(256, 256)
    assert len(words) > 20
    for i, w in words.items():
        assert len(w) < 64
        if not w:
            assert got[i]["log_prob"] == 0
            continue
        ids = []
        for x in w:
            core = x.rstrip(".,;:!?").encode()
            letters = sum(c >= 128 or chr(c).isalpha() for c in core)
            kind = 0 if core and letters == len(core) else 1 if letters else 2
            ids.append(number.get(x, kind * 8 + min(3, len(core) // 3) * 2 + (len(core) != len(x.encode()))))
        around = [lex.end] * 2 + ids + [lex.end] * 2
        plain, mixed = [], []
        for j, (x, y) in enumerate(zip(w, ids, strict=True)):
            h = np.tanh(sum(net.words[c] @ net.place[k * lm_score.HIDDEN : (k + 1) * lm_score.HIDDEN] for k, c in enumerate([around[j], around[j + 1], around[j + 3], around[j + 4]])) + net.bias)
            z = h @ net.top + net.top_bias
            lp = z[lex.first[y]] - np.log(np.exp(z).sum())
            if lex.second[y] >= 0:
                c = lex.first[y] - lm_score.OWN - lm_score.SHAPES
                z = h @ net.inner[c] + net.inner_bias[c]
                lp += z[lex.second[y]] - np.log(np.exp(z).sum())
            if y < lm_score.SHAPES:
                b = x.encode()
                lp += sum(spell[p, q] for p, q in zip(b"\0" + b, b + b"\0", strict=True))
            more = often[tuple(padded[i][j : j + 5])] - 1
            plain.append(lp - math.log(2))
            if more:
                mixed.append(math.log((math.exp(lp) + more / (more + 1)) / 2))
        share = len(mixed) / len(w)
        want = (1 - share) * sum(plain) + share * len(w) * (np.mean(mixed) if mixed else 0)
        assert got[i]["n_tokens"] == len(w) and abs(got[i]["log_prob"] - want) < 1e-3 * max(1, abs(want)), i


def test_lm_does_not_depend_on_partitions(spark):
    docs = documents(spark)
    one, four = ({r["doc_id"]: r["log_prob"] for r in lm_score.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(4)))
    assert one.keys() == four.keys() and max(abs(one[i] - four[i]) for i in one) < 1e-3


def test_lm_outputs_are_a_distribution():
    words = [f"w{i}" for i in range(300)]
    lex = lm_score.Lexicon(words, np.arange(300, 0, -1), np.full(lm_score.SHAPES, 5.0), np.ones(65536))
    net, ctx = lm_score.Net(lex, 3), np.array([[4, 9, 30, lex.end]])
    every = [net.log_probs(ctx, lex.first[[y]], lex.second[[y]])[0] for y in range(lex.end)]
    assert abs(np.exp(every).sum() - 1) < 1e-4
    assert abs(np.exp(lex.spell.reshape(256, 256)).sum(1) - 1).max() < 1e-9


# ---- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    verdict = plain_quality([(r["doc_id"], r["text"], r["lang"]) for r in rows.values()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    one = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert one.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert kept == {i: r["text"] for i, r in rows.items() if verdict[i, r["text"]][2]}

    lines = brute.line_dedup(list(kept.items()), line_dedup.MIN_WORDS, line_dedup.SHORT_WORDS, line_dedup.FREQUENT)
    after = {i: lines.get((i, t), t) for i, t in kept.items()}
    after = {i: t for i, t in after.items() if t == kept[i] or brute.words_of(t)}
    two = corpus_pipeline.line_dedup_stage(spark, one, SMALL)
    assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()} == after
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect() if r["text"] != kept[r["doc_id"]])

    links = brute.jaccard(list(after.items()))
    three = corpus_pipeline.near_duplicates_stage(spark, two, SMALL)
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == sorted(i for i, (_, c) in links.items() if i == c)

    four = corpus_pipeline.mixing_stage(spark, three, SMALL)
    assert four.columns == docs.columns
    con = duckdb.connect()
    con.register("documents", three.toArrow())
    want = sorted(con.execute(f"select doc_id, text_md5 from ({mixing.ORACLE})").fetchall())
    assert sorted((r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in four.collect()) == want

    five = corpus_pipeline.packing_stage(spark, four, SMALL).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [r["text"] for r in four.collect()]
    assert five.length.sum() == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    run = corpus_pipeline.run(spark, SMALL).toPandas()
    assert run.length.sum() == five.length.sum() and sorted(run.groupby("doc_id").length.sum()) == sorted(five.groupby("doc_id").length.sum())


def test_pipeline_stages_of_odd_tables(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, u string, rows int, _rank int"
    for rows in ([], [(None, None, None, None, None, 1, "a", 2, 3), (1, "", "en", "s", 0, 1, "a", 2, 3), (1, "", "en", "s", 0, 1, "a", 2, 3), (2, "some words here", "en", "s", 15, 1, "a", 2, 3), (2, "some words here", "en", "s", 15, 1, "a", 2, 3)]):
        docs = spark.createDataFrame(rows, columns)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert n == 4 or out.columns == docs.columns
            got = [r["doc_id"] for r in out.collect()]
            if rows and n == 1:
                assert sorted(got, key=str) == sorted([r[0] for r in rows], key=str)
            if rows and n == 2:
                assert got.count(2) == 1 and got.count(1) == 2 and got.count(None) == 1
