"""Approximate nearest neighbours: an inverted file with product quantisation and exact reranking.

Unit vectors are assigned to coarse centroids; residuals are coded by a
product quantiser.  A query probes the lists of its nearest centroids, scores
codes through tables of its inner products with the sub-centroids, and the
best RERANK of each block are ranked again by their exact cosine in double
precision on the original vectors; so are all others whose score is within
their quantisation error of the k-th exact one, so that a block's k nearest are
never cut.

Centroids are fitted on a bounded sample (SAMPLE vectors for a list, by a hash
of the id); every vector is indexed.  How many lists a query probes is measured:
TRIALS queries, by a hash of the id, are compared with all vectors in one pass,
and so many lists are probed as hold SHARE of what they found.  So vectors in
clusters need few lists, and vectors without any, as in the test tables, most.
Lists are cut into blocks of about BLOCK rows and a list's queries into blocks
of about QUERIES, so no task grows with a list; equal vectors in a block count
once, with as many ids as can be asked for, so that copies do not crowd out
others.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than the most common;
ids that are null neither.  Rows that share the query's id are its own.
Ties go to the smaller id; a repeated (id, vector) counts once.  An empty
table gives an empty result.  Only vec_id and embedding are read, so names
cannot clash.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, revive, table, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that the centroids are fitted on, for each list and at least; the most lists.
SAMPLE, SAMPLE_LEAST, MAX_LISTS = 16, 16_384, 8192
#: Queries that the number of probed lists is measured with, and the share of their nearest that must lie in them.
TRIALS, SHARE = 128, 0.97
SUBSPACES, CODES = 16, 256
RERANK = 100
BLOCK, QUERIES, AT_ONCE = 4096, 4096, 256
#: More than rounding in single precision can move a score.
ROUNDING = 1e-4


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


class Index:
    """Coarse centroids and sub-centroids."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = kmeans(x.astype(np.float32), lists, 12, 1)
        rest = (x - self.coarse[self.near(x, 1)[:, 0]]).astype(np.float32)
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.subs = [kmeans(rest[:, a:b], CODES, 8, 2 + a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        s = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        return np.argsort(-s, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[at]
        return np.stack([(rest[:, a:b] @ s.T - 0.5 * (s * s).sum(1)).argmax(1) for a, b, s in zip(self.cuts, self.cuts[1:], self.subs, strict=False)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, query x code: inner products."""
        return [q[:, a:b] @ s.T for a, b, s in zip(self.cuts, self.cuts[1:], self.subs, strict=False)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True)).astype(np.float32)


def rows_of(df: DataFrame, dim: int) -> np.ndarray:
    """A bounded DataFrame's column v as a matrix."""
    got = df.select("v").toArrow()["v"].combine_chunks()
    return got.flatten().to_numpy().reshape(-1, dim)


def probes_needed(coded: DataFrame, trials: DataFrame, index: Index, dim: int, k: int) -> int:
    """The least number of lists, nearest first, that hold SHARE of the k nearest of the trial queries among all vectors of the index."""
    got = trials.select("vec_id", "v").toArrow()
    ids, q = got["vec_id"].to_numpy(), unit(got["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
    shared = coded.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches):
        ids, q = shared.value
        held = [(np.zeros(0, np.float32), np.zeros(0, np.int32))] * len(ids)
        for b in batches:
            if len(b):
                x = unit(b.column(1).flatten().to_numpy().reshape(len(b), -1))
                own, lists = b.column(0).to_numpy(), b.column(2).to_numpy()
                for i, s in enumerate(q @ x.T):
                    s[own == ids[i]] = -np.inf
                    top = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                    score, at = np.concatenate([held[i][0], s[top]]), np.concatenate([held[i][1], lists[top]])
                    order = np.argsort(-score, kind="stable")[:k]
                    held[i] = (score[order], at[order])
        rows = [(i, float(s), int(at)) for i, (score, lists) in enumerate(held) for s, at in zip(score, lists, strict=True) if np.isfinite(s)]
        yield pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], pa.int32()), "score": pa.array([r[1] for r in rows], pa.float64()), "list": pa.array([r[2] for r in rows], pa.int32())})

    found = coded.select("vec_id", "v", "list").mapInArrow(tidy(best), "q int, score double, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))
    found = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "list").collect()  # TRIALS x k rows
    shared.destroy()
    place = np.argsort(index.near(q, len(index.coarse)), axis=1)
    at = np.sort([place[r["q"], r["list"]] for r in found])
    return int(at[min(len(at) - 1, int(np.ceil(SHARE * len(at))))]) + 1 if len(at) else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out_schema)
    dim, n = sizes[0]["d"], sizes[0]["n"]
    v = v.where(F.size("v") == dim)
    lists = max(1, min(MAX_LISTS, int(n**0.5 / 4)))
    want = max(SAMPLE_LEAST, SAMPLE * lists)
    take = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000_000)) < min(1_000_000_000, want * 1_000_000_000 // n + 1)).limit(2 * want)
    sample = rows_of(take, dim)
    if not len(sample):
        sample = rows_of(v.limit(CODES), dim)
    index = Index(unit(sample), lists)
    shared = spark.sparkContext.broadcast(index.__dict__)  # MAX_LISTS + CODES vectors at most

    def assign(batches):
        index = revive(Index, shared.value)
        for b in batches:
            if len(b):
                x = unit(b.column(1).flatten().to_numpy().reshape(len(b), -1))
                at = index.near(x, 1)[:, 0]
                codes = [c.tobytes() for c in index.encode(x, at)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "v", "list", "code"])

    def probe(batches):
        index = revive(Index, shared.value)
        for b in batches:
            if len(b):
                at = index.near(unit(b.column(1).flatten().to_numpy().reshape(len(b), -1)), probes)
                rows = np.repeat(np.arange(len(b)), at.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(at.ravel(), pa.int32())], names=["query_id", "q", "list"])

    coded = cut(v.mapInArrow(tidy(assign), "vec_id bigint, v array<double>, list int, code binary"), "ann-index")
    queries = v.where(is_query).dropDuplicates(["vec_id"])
    probes = probes_needed(coded, queries.orderBy(F.xxhash64("vec_id")).limit(TRIALS), index, dim, k)
    asked = cut(queries.mapInArrow(tidy(probe), "query_id bigint, q array<double>, list int"), "ann-probes")
    # a row for each list, of which there are MAX_LISTS at most
    parts = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vp")).join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qp")), "list")
    parts = F.broadcast(parts.limit(MAX_LISTS))
    lists_ = coded.join(parts, "list").withColumn("p", F.pmod(F.xxhash64("vec_id"), F.col("vp")).cast("int")).select("list", "p", F.explode(F.sequence(F.lit(0), F.col("qp") - 1)).alias("r"), "vec_id", "v", "code")
    asks = asked.join(parts, "list").withColumn("r", F.pmod(F.xxhash64("query_id"), F.col("qp")).cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("vp") - 1)).alias("p"), "r", "query_id", "q")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("vec_id", kind="stable")
        x, ids = np.vstack(left["v"].to_numpy()), left["vec_id"].to_numpy()
        _, first, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[order], np.arange(len(first) + 1))
        x = x[first]
        codes = np.frombuffer(b"".join(left["code"].to_numpy()), np.uint8).reshape(len(left), -1)[first]
        q, qids = np.vstack(right["q"].to_numpy()), right["query_id"].to_numpy()
        near, index = unit(q), revive(Index, shared.value)
        # a unit query moves a score by no more than the length of what the code leaves of the vector
        coded = np.hstack([s[codes[:, m]] for m, s in enumerate(index.subs)])
        slack = np.linalg.norm(unit(x) - index.coarse[key[0]] - coded, axis=1) + ROUNDING
        norms, qnorms = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        out_q, out_v, out_s = [], [], []

        def ranked(i, top):
            exact = (x[top] * q[i]).sum(1) / (norms[top] * qnorms[i])
            top, exact = (y[np.argsort(-exact, kind="stable")] for y in (top, exact))
            got = []
            for t, s in zip(top, exact, strict=True):
                if len(got) > k and s < got[k][0]:
                    break
                own = np.unique(ids[order[begin[t] : begin[t + 1]]])[: k + 1]
                got += [(s, j) for j in own if j != qids[i]]
                got.sort(key=lambda y: (-y[0], y[1]))
                got = got[: k + 1]
            return got

        for i in range(len(q)):
            if i % AT_ONCE == 0:
                some = near[i : i + AT_ONCE]
                scores = (some @ index.coarse[key[0]])[:, None] + sum(t[:, codes[:, m]] for m, t in enumerate(index.tables(some)))
            s = scores[i % AT_ONCE]
            top = np.argpartition(-s, RERANK)[:RERANK] if len(x) > RERANK else np.arange(len(x))
            got = ranked(i, top)
            if len(x) > RERANK:
                least = got[k - 1][0] if len(got) >= k else -np.inf
                near_enough = s + slack >= least
                near_enough[top] = False
                more = np.flatnonzero(near_enough)
                more = more[x[more] @ q[i] >= (least - ROUNDING) * norms[more] * qnorms[i]]
                if len(more):
                    got = ranked(i, np.sort(np.concatenate([top, more])))
            out_q += [qids[i]] * len(got[:k])
            out_v += [j for _, j in got[:k]]
            out_s += [s for s, _ in got[:k]]
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}) if out_q else none

    found = lists_.groupBy("list", "p", "r").cogroup(asks.groupBy("list", "p", "r")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.dropDuplicates(["query_id", "vec_id", "score"]).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
