"""Line dedup by winnowing over line hashes.

A document's units are its lines that hold a word, without surrounding white
space.  A window is the shortest run of lines from some line on with MIN_WORDS
words.  Winnowing selects each window's smallest line hash, rightmost at ties;
the distinct (hash, position) pairs are the document's fingerprints, and a run
of MIN_WORDS words or more that two places share has one in common.  A line of
at least SHORT_WORDS but fewer words is a fingerprint of its own, which counts
only if it is found at FREQUENT places: a boilerplate line.

Fingerprints that occur at one place alone are dropped: what they cover is not
repeated.  The windows that the others stand for are joined to the first place,
by (doc_id, line), with their content.  Matches on a diagonal are joined to
runs, runs are extended both ways while lines agree, and later runs are
deleted; every deleted line has an equal one at an earlier place that stays.

Shorter repeats stay: lines of under SHORT_WORDS words, lines of under
MIN_WORDS words at fewer than FREQUENT places, and what a passage shares with
another in parts of lines, as lines are the units.

Only hashes and positions are shuffled, then the text once.  The hot key (a
line or passage in a third of all rows) is combined before the shuffle; the joins
back to it are equi-joins of plain shuffles that adaptive execution splits.

Defined results: null text stays null; empty lines stay unless a deleted run
encloses them.  Null ids come last.  Rows equal in doc_id and text are one
document to the operator and treated alike.  An empty table gives an empty
result.  Other columns are carried along; names that start with ``_ld_`` are
reserved.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, cut, mix64, small_batches, table, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that a repeated run has at least.
MIN_WORDS = 20
#: Words of a shorter line, and places at which it is boilerplate.
SHORT_WORDS, FREQUENT = 8, 20

#: marks: a fingerprint with the windows (first unit, end, content) that chose it.
UNITS = "_ld_k bigint, doc_id bigint, line array<int>, hash array<bigint>, marks array<struct<mark:bigint,short:boolean,windows:array<struct<first:int,last:int,window:bigint>>>>"


def units_of(text: str, min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS) -> tuple[list[int], np.ndarray, list[dict]]:
    """Line numbers, line hashes, and the fingerprints with their windows."""
    lines, hashes, words = [], [], []
    for i, x in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if n := len(x.split()):
            lines.append(i)
            hashes.append(xxhash.xxh64_intdigest(x.strip()))
            words.append(n)
    h = np.array(hashes, np.uint64)
    sums = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    last = np.searchsorted(sums, sums[:-1] + min_words)  # window i is [i, last)
    last = last[: int((last <= len(lines)).sum())]
    signed = h.view(np.int64).tolist()
    out = [{"mark": signed[i], "short": True, "windows": [{"first": i, "last": i + 1, "window": signed[i]}]} for i, n in enumerate(words) if short_words <= n < min_words]
    if not len(last):
        return lines, h, out
    # polynomial of the hashes, modulo 2^64: window = pre[last] - pre[first] * base^length
    pre, acc, base = [0], 0, int(MIX)
    for x in hashes:
        acc = (acc * base + x) & 0xFFFFFFFFFFFFFFFF
        pre.append(acc)
    pre = np.array(pre, np.uint64)
    length = last - np.arange(len(last))
    power = np.ones(int(length.max()) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, MIX))
    content = mix64(pre[last] - pre[: len(last)] * power[length] + length.astype(np.uint64)).view(np.int64).tolist()
    best, chosen, end = -1, -1, 0
    for i, stop in enumerate(last.tolist()):
        if best < i:
            best, end = i, i + 1
        for j in range(end, stop):
            if hashes[j] <= hashes[best]:
                best = j
        end = stop
        if best != chosen:
            out.append({"mark": signed[best], "short": False, "windows": []})
            chosen = best
        out[-1]["windows"].append({"first": i, "last": stop, "window": content[i]})
    return lines, h, out


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """_ld_k and runs: the lines to delete of each document that has any, as array<struct<a, b, of>> with line numbers and the first place's doc_id."""
    small_batches(docs.sparkSession)

    def run(batches):
        names = ["_ld_k", "doc_id", "line", "hash", "marks"]
        window = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("window", pa.int64())])
        marks = pa.list_(pa.struct([("mark", pa.int64()), ("short", pa.bool_()), ("windows", pa.list_(window))]))
        for b in batches:
            rows = [(k, d, *units_of(t, min_words, short_words)) for k, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t]
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int32())), pa.array([x.view(np.int64) for x in c[3]], pa.list_(pa.int64())), pa.array(c[4], marks)], names=names)

    units = cut(docs.select("_ld_k", "doc_id", "text").mapInArrow(tidy(run), UNITS), "line-units")
    marks = units.select("_ld_k", "doc_id", F.explode("marks").alias("m")).select("m.*", "_ld_k", "doc_id")
    # a fingerprint that is found once, or a short line that is not frequent, repeats nothing
    shared = marks.groupBy("mark", "short").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.when(F.col("short"), F.lit(frequent)).otherwise(F.lit(2))).select("mark", "short")
    marks = marks.join(cut(shared, "line-marks"), ["mark", "short"], "left_semi")
    at = marks.select("mark", "short", "_ld_k", "doc_id", F.explode("windows").alias("w")).select("mark", "short", "w.window", "w.last", "_ld_k", F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("_ld_k").alias("k"), F.col("w.first").alias("i")).alias("place"))
    at = cut(at, "line-places")
    earliest = at.groupBy("mark", "short", "window").agg(F.min("place").alias("of"), F.max("place").alias("to")).where("of != to").drop("to")
    # as tables, the small sides leave joins of plain shuffles, which adaptive execution splits at a hot passage
    earliest = cut(earliest, "line-earliest")
    hits = at.join(earliest, ["mark", "short", "window"]).where("place != of")
    # matches on one diagonal, end to end: a run from its first window's first unit to its last window's last
    hits = hits.select("_ld_k", F.col("place.i").alias("a"), F.col("last").alias("b"), F.col("of.k").alias("fk"), F.col("of.d").alias("fd"), (F.col("of.i") - F.col("place.i")).alias("shift"))
    runs = hits.groupBy("_ld_k", "fk", "fd", "shift").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("w"))
    merged = F.aggregate(
        "w", F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), x["b"].alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))),
    )
    runs = runs.select("_ld_k", "fk", "fd", "shift", F.explode(merged).alias("r")).select("_ld_k", "fk", "fd", "shift", "r.*")
    # what is still equal beyond a run has under min_words words, hence fewer lines than that
    runs = cut(runs.select("_ld_k", "fk", "fd", "a", "b", (F.col("a") + F.col("shift")).alias("fa"), (F.col("b") + F.col("shift")).alias("fb")), "line-runs")

    def around(h: str, a: str, b: str, out: str) -> dict:
        """The hashes after a run and, nearest first, those before it."""
        return {f"{out}_after": F.slice(h, F.col(b) + 1, F.lit(min_words)), f"{out}_before": F.reverse(F.slice(h, F.greatest(F.col(a) - min_words, F.lit(0)) + 1, F.least(F.col(a), F.lit(min_words))))}

    # a first place's surroundings are cut out once, however often it is repeated
    firsts = runs.select("fk", "fa", "fb").distinct()
    theirs = firsts.join(units.dropDuplicates(["_ld_k"]).select(F.col("_ld_k").alias("fk"), "hash"), "fk").withColumns(around("hash", "fa", "fb", "f")).drop("hash")
    runs = runs.join(cut(theirs, "line-firsts"), ["fk", "fa", "fb"])
    runs = runs.join(units.dropDuplicates(["_ld_k"]).select("_ld_k", "line", "hash"), "_ld_k").withColumns(around("hash", "a", "b", "x"))

    def agreeing(x: str, y: str):
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(x)).cast("int")

    runs = runs.withColumns({"a": F.col("a") - agreeing("x_before", "f_before"), "b": F.col("b") + agreeing("x_after", "f_after")})
    runs = runs.select("_ld_k", F.struct(F.get("line", F.col("a")).alias("a"), F.get("line", F.col("b") - 1).alias("b"), F.col("fd").alias("of")).alias("r"))
    return runs.groupBy("_ld_k").agg(F.array_sort(F.collect_set("r")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """docs with text lacking later repeated runs, plus _ld_lines, _ld_removed (lines) and _ld_runs."""
    keyed = docs.withColumn("_ld_k", F.xxhash64("doc_id", "text"))
    out = keyed.join(find_runs(keyed, min_words, short_words, frequent), "_ld_k", "left")
    merged = F.aggregate(
        "runs", F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["a"] - 1), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(x["b"], F.get(acc, F.size(acc) - 1)["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))),
    )
    out = out.withColumn("_ld_cut", F.when(F.col("runs").isNotNull(), merged)).withColumn("_ld_all", F.when(F.col("runs").isNotNull(), F.split("text", "\n")))
    kept = F.filter("_ld_all", lambda x, i: ~F.exists("_ld_cut", lambda v: i.between(v["a"], v["b"])))
    out = out.withColumn("_ld_kept", F.when(F.col("runs").isNotNull(), kept))
    return out.select(
        *[F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("_ld_kept", "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).alias("_ld_lines"),
        F.coalesce(F.size("_ld_all") - F.size("_ld_kept"), F.lit(0)).alias("_ld_removed"), F.col("runs").alias("_ld_runs"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.transform("_ld_runs", lambda r: F.struct(r["a"].alias("first_line"), r["b"].alias("last_line"), r["of"].alias("of_doc"))).alias("removed"))
