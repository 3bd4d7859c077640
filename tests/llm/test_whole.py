"""Cases in which an operator once did less than its whole job."""

import itertools
import pathlib
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from veilspark.llm import jaccard_join, language, lm_score, nearest, quality

from . import brute
from .test_brute import hold_quality


def test_lm_trains_on_every_position(spark):
    for n in range(40):
        for rounds in (1, 2, 5):
            at = np.concatenate([lm_score.masked(n * 7, n, i, rounds) for i in range(rounds)])
            assert sorted(at) == list(range(n))
    # texts of six words: with the rounds of the query, the words' order must be learnt
    words = ["ka", "lo", "mi", "te", "ru", "san"]
    rows = [(i, " ".join(words)) for i in range(6000)] + [(9000, " ".join(words[::-1]))]
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()}
    assert got[0] > got[9000] + 1


def test_nearest_within_a_tight_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) + 0.05 * rng.normal(size=(2000, 64))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = nearest.nearest(table, F.col("vec_id") % 150 == 0).toPandas()
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 6000, 150):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    print("recall", hits / 200)
    assert hits >= 195


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    cases = [np.array([[-7, 0, -50]] * 2 + [[-7, -50, 0]] * 2, np.float32)] + [rng.choice([-50, -14, -7, -3, 0], (5, 3)).astype(np.float32) for _ in range(300)]
    for s in cases:
        cost = lambda p: s[np.arange(len(s)), list(p)].sum() - language.SWITCH * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert cost(language.viterbi(s)) >= max(map(cost, itertools.product(range(3), repeat=len(s)))) - 1e-3
    assert list(language.viterbi(cases[0])) == [1, 1, 2, 2]


def test_jaccard_of_short_sets_of_heavy_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "HEAVY", 1)
    rng = np.random.default_rng(11)
    rows, n = [], 400
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 14)]
        # texts of one shingle are every star's pivot and link with neither; the other two have 9 of 10 shingles in common
        rows += [(12 * i + j, " ".join(w[j : j + 5])) for j in range(10)]
        rows += [(12 * i + 10, " ".join(w)), (12 * i + 11, " ".join([*w[:13], "z"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    lost = [i for i in range(n) if got[12 * i + 11] != 12 * i + 10]
    print("lost links", len(lost))
    assert not lost


def test_large_group_of_near_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(5, 115), 1 + i % 3):
            words[at] = f"n{i}x{at}"
        texts.append((i, " ".join(words)))
    tried = []
    plain = jaccard_join.compare

    def counted(pairs, docs, percent, kind):
        tried.append(pairs.count())
        return plain(pairs, docs, percent, kind)

    monkeypatch.setattr(jaccard_join, "compare", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard(texts)
    assert sum(tried) < 20 * len(texts)


def test_jaccard_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, m, both = (int(x) for x in rng.integers(1, 700, 3))
        s = rng.integers(0, 2**64, n + m + both, np.uint64, endpoint=False)
        x, y = np.unique(s[: n + both]), np.unique(s[n:])
        apart = jaccard_join.differing(jaccard_join.parities(x), jaccard_join.parities(y))
        exact = len(np.setxor1d(x, y))
        assert apart <= exact and (exact - apart) % 2 == 0
        # of sets that sizes let link, a good part of the difference shows
        assert apart > exact / 4 or exact < 50 or min(len(x), len(y)) < 0.8 * max(len(x), len(y))
        assert jaccard_join.differing(jaccard_join.parities(y), jaccard_join.parities(x)) == apart


def test_sets_of_long_texts_that_only_share_passages_do_not_travel(spark, monkeypatch):
    # 60 % of the shingles are shared: prefixes meet, and 512 parities are too few to tell such sets apart
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared, rows = word(2400), []
    for _ in range(20):
        own = word(800)
        rows.append((len(rows), " ".join([*shared, *own])))
    near = rows[3][1].split(" ")
    near[500] = near[2900] = "z"
    rows.append((len(rows), " ".join(near)))
    whole, plain = [], jaccard_join.cut

    def counted(df, name):
        out = plain(df, name)
        if name == "join-tried":
            whole.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute.jaccard(rows)
    assert got[20][1] == 3
    print("pairs whose whole sets were joined", whole)
    assert sum(whole) < 10


def test_quality_trains_on_all_trusted_documents(spark, monkeypatch):
    # many shards, and few n-grams that every task knows; over 2,000 trusted documents in the fold that trains
    monkeypatch.setattr(quality, "SHARD", 3000)
    monkeypatch.setattr(quality, "HOT", 100)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 997}" for _ in range(9)), "en") for i in range(5000)]
    labels = [(i, 1, 0) for i in range(5000)]
    hold_quality(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_lm_counts_every_window_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 1000)
    monkeypatch.setattr(lm_score, "SHARD_WINDOWS", 500)
    seen = []
    real = lm_score.recurring

    def kept(*a):
        out = real(*a)
        seen.extend(np.concatenate([np.frombuffer(r["c"], np.int64) for r in out.collect()]))
        return out

    monkeypatch.setattr(lm_score, "recurring", kept)
    rng = random.Random(4)
    long = [f"v{rng.randrange(10**9)}" for _ in range(3000)]
    # of the long text's windows, those in the middle of each short one recur: 4 of 8
    shorts = [" ".join(long[i : i + 8]) for i in range(100, 2900, 100)]
    alone = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(8)) for _ in shorts]
    rows = [(0, " ".join(long)), *enumerate(shorts + alone, 1)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    # told to the block of either text, once if both are in one
    assert set(seen) == {2} and 4 * len(shorts) <= len(seen) <= 8 * len(shorts)
    assert min(got[i] for i in range(1, len(shorts) + 1)) > max(got[i] for i in range(len(shorts) + 1, len(rows))) + 1


def test_quality_model_and_answers_stay_small(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD", 6000)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60)), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    live, peak, answers = {}, [0], []
    cut, done, ask = quality.cut, quality.done, PandasCogroupedOps.applyInArrow

    def kept(df, name):
        out = cut(df, name)
        live[out._cut_to] = sum(f.stat().st_size for f in pathlib.Path(out._cut_to).glob("*.parquet")) if name not in ("quality-training", "quality-words") else 0
        peak[0] = max(peak[0], sum(live.values()))
        return out

    def removed(*tables):
        for t in tables:
            live.pop(t._cut_to)
        done(*tables)

    def asked(self, *a):
        answers.append(ask(self, *a).count())
        return ask(self, *a)

    monkeypatch.setattr(quality, "cut", kept)
    monkeypatch.setattr(quality, "done", removed)
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", asked)
    assert quality.judge(docs, labels).count() == 3000
    print("bytes a trigram", peak[0] / (1500 * 61), "answers", sum(answers))
    # no row for each text and shard; about a trigram and a pair for each token are kept
    assert sum(answers) < len(rows)
    assert peak[0] < 28 * 1500 * 61


def test_lm_step_moves_words_by_the_sums_of_their_gradients():
    words = [f"w{i}" for i in range(300)]
    lex = lm_score.Lexicon(words, np.arange(300, 0, -1), np.ones(lm_score.SHAPES), np.ones(65536))
    rng = np.random.default_rng(7)
    ids = rng.integers(0, lex.end, 2000).astype(np.uint16)
    texts, net = lm_score.Texts([ids.tobytes()], lex.end), lm_score.Net(lex)
    at = np.arange(1500)
    y, ctx, before = texts.ids[at], texts.contexts(at), net.words.copy()
    loss = lambda: -net.log_probs(ctx, lex.first[y], lex.second[y]).mean()
    slopes = []
    for row, i in ((int(ctx[5, 0]), 3), (int(ctx[9, 2]), 8)):
        net.words[row, i] = before[row, i] + 0.02
        high = loss()
        net.words[row, i] = before[row, i] - 0.02
        slopes.append((row, i, (high - loss()) / 0.04))
        net.words[row, i] = before[row, i]
    seen = [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]
    net.step(ctx, lex.first[y], lex.second[y], seen)
    for row, i, g in slopes:
        assert abs(before[row, i] - net.words[row, i] - lm_score.RATE * g / np.sqrt(1e-4 + g * g)) < 1e-3
    absent = np.setdiff1d(np.arange(lex.end + 1), ctx)
    assert (net.words[absent] == before[absent]).all()


def test_lm_step_takes_all_clusters_at_once(monkeypatch):
    words = [f"w{i}" for i in range(lm_score.VOCAB)]
    lex = lm_score.Lexicon(words, np.arange(len(words), 0, -1), np.ones(lm_score.SHAPES), np.ones(65536))
    rng = np.random.default_rng(8)
    texts, net = lm_score.Texts([rng.integers(0, lex.end, lm_score.BATCH).astype(np.uint16).tobytes()], lex.end), lm_score.Net(lex)
    y, ctx = texts.ids, texts.contexts(slice(None))
    first, second = lex.first[y], lex.second[y]
    assert set(first[second >= 0]) == set(range(lm_score.OWN + lm_score.SHAPES, lm_score.FIRST))
    # the same step, cluster by cluster in double precision
    x = net.words[ctx].reshape(len(y), -1).astype(float)
    h = np.tanh(x @ net.place + net.bias)
    top, inner, dh = np.zeros(net.top.shape), np.zeros(net.inner.shape), np.zeros(h.shape)

    def level(rows, w, bias, own, g):
        z = np.exp(h[rows] @ w + bias)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(rows)), own] -= 1
        z /= len(y)
        dh[rows] += z @ w.T
        g += h[rows].T @ z
        return z.sum(0)

    top_bias = level(np.arange(len(y)), net.top, net.top_bias, first, top)
    inner_bias = np.zeros(net.inner_bias.shape)
    for c in range(lm_score.CLUSTERS):
        rows = np.flatnonzero(first == lm_score.OWN + lm_score.SHAPES + c)
        inner_bias[c] = level(rows, net.inner[c], net.inner_bias[c], second[rows], inner[c])
    dh *= 1 - h * h
    g_words = np.zeros(net.words.shape)
    np.add.at(g_words, ctx, (dh @ net.place.T).reshape(*ctx.shape, -1))
    slopes = {"words": g_words, "place": x.T @ dh, "bias": dh.sum(0), "top": top, "top_bias": top_bias, "inner": inner, "inner_bias": inner_bias}
    want = {k: getattr(net, k) - lm_score.RATE * g / np.sqrt(1e-4 + g * g) for k, g in slopes.items()}
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    net.step(ctx, first, second, [np.full(p.shape, 1e-4, np.float32) for p in net.parts()])
    monkeypatch.undo()
    for k, w in want.items():
        assert abs(getattr(net, k) - w).max() < 1e-4, k
    # a handful of passes over all outputs, instead of one for each cluster
    assert len(calls) < lm_score.CLUSTERS // 2
