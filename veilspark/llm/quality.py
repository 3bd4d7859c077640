"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted documents are those labelled of good quality and not toxic.  All those
of one fold (by a hash of the id) train the model: trigrams are counted in shards
by their first two words; continuation counts, discounts and context weights
are aggregates of those.  The words are all that they hold more than twice (the
LISTED most frequent, if more); any other is its shape (case, marks, length),
so invented words are no surprise but odd marks are.  Words and shapes are
64-bit hashes, whose equality is taken for theirs.

A log-probability is a sum of terms by word, which are broadcast, and of a
bonus for each n-gram that training has met.  These stay in shards by an
n-gram's last two words, whose number follows from that of all words: texts ask
shards for the sums of their n-grams, one question for a trigram and its pair, in
TURNS parts, so that the questions of one part are on disk at once; only the
HOT most frequent are known to every task.  A document's perplexity is held
against its language's quantile over all trusted documents that did not train; short
texts, whose means vary most, are drawn towards the language's median first.

Defined results: null, empty and blank texts have no perplexity and are
rejected; languages (null is one) without enough trusted documents take the
quantile over all; without any trusted document nothing else is rejected.
Null ids are scored, not trained on; equal ids share a label; contradicting
labels are not trusted.  Columns of the documents are carried along; names
that start with ``_q_`` are reserved.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, HashIndex, cut, done, mix64, revive, small_batches, table, tidy  # noqa: F401
from .lm_score import hashes_of_all, tokens
from .url_filter import build_filter, may_hold, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words with ids of their own, at most: the most frequent; all others are counted by shape.  Three ids fit a key of 60 bits.
LISTED = (1 << 20) - 1024
#: Trusted documents that a language needs for a threshold of its own.
LEAST = 30
#: A document is rejected beyond this quantile of trusted perplexities, times MARGIN.
QUANTILE, MARGIN = 0.99, 1.25
#: A short text's mean is drawn to its language's median as by so many further tokens.
PRIOR = 8
#: N-grams of a shard of the model, about; the most n-grams that every task knows; parts in which texts are looked up, and in which trigrams change shards.
SHARD, HOT, TURNS, PARTS = 500_000, 1 << 18, 6, 3
#: Bits of a word in a key, and masks of the last word and the last two.
LOW, LOW_ONE, LOW_TWO = np.uint64(20), np.uint64((1 << 20) - 1), np.uint64((1 << 40) - 1)
START, END = 0, 1


def shape(word: str) -> str:
    core = word.rstrip(".,;:!?")
    tail = word[len(core) :]
    if core.isalpha():
        kind = "low" if core.islower() else "title" if core.istitle() else "up" if core.isupper() else "mixed"
    else:
        letters = sum(map(str.isalpha, core))
        kind = "none" if not letters else "digit" if core.isalnum() else "part"
    end = tail if len(tail) < 2 else "many"
    return f"\n{kind}{min(3, len(core) // 5)}{end}"


class Words:
    """Ids of words: places among the listed hashes, from 3 on; any that is not listed has its shape's, or that of all other shapes."""

    def __init__(self, listed: np.ndarray):
        self.index = HashIndex(listed)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts end to end, each after START, START and before END, and each text's number of words."""
        words, at, sizes = tokens(column, lower=False)
        found = self.index.find(hashes_of_all(words)) + 3
        rare = np.flatnonzero(found == 2)
        if len(rare):
            found[rare] = self.index.find(hashes_of_all(pa.array([shape(w) for w in words.take(pa.array(rare)).to_pylist()], pa.string()))) + 3
        out = np.full(len(at) + 3 * len(sizes), START, np.int64)
        out[np.arange(len(at)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)] = found[at]
        out[np.cumsum(sizes + 3) - 1] = END
        return out, sizes


def pack(*ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        out = (out << np.uint64(20)) | x.astype(np.uint64)
    return out


def trigrams(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams within texts, and each one's text."""
    inside = text[2:] == text[:-2]
    return pack(ids[:-2], ids[1:-1], ids[2:])[inside], text[2:][inside]


class Lower:
    """Of words by id: log-probability l, and log of the share of discounts b where one is the context; of contexts total t, sum of discounts w."""

    def __init__(self, listed: np.ndarray, uni: np.ndarray, t: np.ndarray, w: np.ndarray):
        self.listed, self.uni, self.t, self.w = listed, uni, t, w

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(self.uni), np.log(self.w / self.t)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed, after their count."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def swell(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def squeeze_sorted(key: np.ndarray) -> bytes:
    return squeeze(np.diff(key, prepend=key.dtype.type(0)))


def swell_sorted(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(swell(data, kind), dtype=kind)


def gathered(column: pa.ChunkedArray, read: Callable, kind: type) -> np.ndarray:
    """What read finds in all values of a column, end to end."""
    return np.concatenate([np.zeros(0, kind), *(read(x, kind) for x in column.to_pylist())])


def shard_of(two: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(two) % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.uint32)


def deal(shard: np.ndarray, shards: int) -> dict[int, np.ndarray]:
    """The places of each shard that occurs, in order."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    return {int(s): order[ends[s] : ends[s + 1]] for s in np.flatnonzero(np.diff(ends))}


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return begin, np.diff(np.append(begin, len(x)))


def histogram(counted: DataFrame) -> dict[int, int]:
    """How many rows each n has, from counted(n, rows)."""
    return {r["n"]: r["rows"] for r in counted.groupBy("n").agg(F.sum("rows").alias("rows")).collect()}


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of n-grams of counts 1 to 4."""
    n = [float(counts.get(i, 0)) for i in (1, 2, 3, 4)]
    if min(n) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)])


def least(counts: dict[int, int], most: int, low: int) -> int:
    """The least n, low or more, that no more than most rows reach."""
    held = 0
    for n in sorted((n for n in counts if n >= low), reverse=True):
        held += counts[n]
        if held > most:
            return n + 1
    return low


def train(sample: DataFrame) -> tuple[Lower, int, DataFrame]:
    """Of sample(text): what is kept by word, the number of shards, and the model: a row for each shard.

    log p(c | a, b) is l[c] + b[b] + bonus(a, b) + bonus(b, c) + bonus(a, b, c),
    where an n-gram that training has not met has bonus 0: a bigram's holds what
    it adds as an n-gram and its share of discounts as a context.

    N-grams travel as sorted arrays.  Trigrams are counted by shards of their
    first two words, where the contexts are whole; then they go to those of
    their last two, where the lower n-grams are whole, in PARTS parts by shard.
    """
    spark = sample.sparkSession

    def count(batches):
        for b in batches:
            words, at, _ = tokens(b.column(0), lower=False)
            n = np.bincount(at, minlength=len(words))
            words, n = words.filter(pa.array(n > 0)), n[n > 0]
            shapes: dict[str, int] = {}
            for w, i in zip(words.to_pylist(), n.tolist(), strict=True):
                shapes[shape(w)] = shapes.get(shape(w), 0) + i
            h = np.concatenate([hashes_of_all(words), hashes_of_all(pa.array(shapes, pa.string()))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([False] * len(words) + [True] * len(shapes)), pa.array([*n.tolist(), *shapes.values()], pa.int64())], names=["h", "s", "n"])

    words = cut(sample.mapInArrow(tidy(count), "h bigint, s boolean, n bigint").groupBy("h").agg(F.first("s").alias("s"), F.sum("n").alias("n")), "quality-words")
    by_n = histogram(words.where("not s").select("n", F.lit(1).alias("rows")))
    listed = words.where(F.col("s") | (F.col("n") >= least(by_n, LISTED, 3))).select("h").toArrow()["h"].to_numpy()  # LISTED at most, and shapes
    listed = np.sort(listed.view(np.uint64))
    done(words)
    size, shards = len(listed) + 3, max(1, -(-sum(n * rows for n, rows in by_n.items()) // SHARD))
    given = spark.sparkContext.broadcast(listed)

    def grams(batches):
        ids = Words(given.value)
        for b in batches:
            x, sizes = ids.ids(b.column(0))
            key, n = np.unique(trigrams(x, np.repeat(np.arange(len(sizes)), sizes + 3))[0], return_counts=True)
            parts = deal(shard_of(key >> LOW, shards), shards)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(parts, pa.int32()), "keys": pa.array([squeeze_sorted(key[i]) for i in parts.values()], pa.binary()), "n": pa.array([squeeze(n[i]) for i in parts.values()], pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        key, at = np.unique(gathered(group["keys"], swell_sorted, np.uint64), return_inverse=True)
        n = np.bincount(at, weights=gathered(group["n"], swell, np.int64)).astype(np.int64)
        return pa.table({"shard": group["shard"][:1], "keys": pa.array([squeeze_sorted(key)], pa.binary()), "n": pa.array([squeeze(n)], pa.binary())})

    packed = "shard int, keys binary, n binary"
    tri = cut(sample.mapInArrow(tidy(grams), packed).groupBy("shard").applyInArrow(summed, packed), "quality-trigrams")
    given.destroy()

    def times(of: Callable):
        def run(batches):
            for b in batches:
                n, rows = np.unique(np.concatenate([np.zeros(0, np.int64), *map(of, b.column(0).to_pylist())]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(rows)], names=["n", "rows"])

        return tidy(run)

    met = histogram(tri.select("n").mapInArrow(times(lambda x: swell(x, np.int64)), "n bigint, rows bigint"))
    d3, limit = discounts(met), least(met, HOT, 2)

    def turned(part: int):
        def run(batches):
            for b in batches:
                for keys, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    key, n = swell_sorted(keys), swell(ns, np.int64)
                    off = d3[np.minimum(n, 3) - 1]
                    begin, length = runs(key >> LOW)
                    ab, w = key[begin] >> LOW, np.add.reduceat(off, begin)
                    back = np.log(w / np.add.reduceat(n, begin)).astype(np.float32)
                    ratio = ((n - off) / np.repeat(w, length)).astype(np.float32)
                    # the last two words first
                    key = (key & LOW_TWO) << LOW | key >> (LOW + LOW)
                    order = np.argsort(key)
                    key, ratio, n = key[order], ratio[order], n[order]
                    three, two = (deal(shard_of(x, shards), shards) for x in (key >> LOW, ab))
                    none = np.zeros(0, np.int64)
                    rows = [(s, three.get(s, none), two.get(s, none)) for s in sorted(three.keys() | two.keys()) if s % PARTS == part]
                    columns = [pa.array([s for s, _, _ in rows], pa.int32()), *(pa.array(v, pa.binary()) for v in ([squeeze_sorted(key[i]) for _, i, _ in rows], [squeeze(ratio[i]) for _, i, _ in rows], [squeeze(n[i]) for _, i, _ in rows], [squeeze_sorted(ab[i]) for _, _, i in rows], [squeeze(back[i]) for _, _, i in rows]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "ratio", "n", "contexts", "back"])

        return tidy(run)

    def met_here(group: pa.Table) -> pa.Table:
        key, ab = gathered(group["keys"], swell_sorted, np.uint64), gathered(group["contexts"], swell_sorted, np.uint64)
        i, j = np.argsort(key), np.argsort(ab)
        columns = squeeze_sorted(key[i]), squeeze(gathered(group["ratio"], swell, np.float32)[i]), squeeze(gathered(group["n"], swell, np.int64)[i]), squeeze_sorted(ab[j]), squeeze(gathered(group["back"], swell, np.float32)[j])
        return pa.table({"shard": group["shard"][:1]} | {name: pa.array([v], pa.binary()) for name, v in zip(("keys", "ratio", "n", "contexts", "back"), columns, strict=True)})

    packed = "shard int, keys binary, ratio binary, n binary, contexts binary, back binary"
    parts = [cut(tri.select("keys", "n").mapInArrow(turned(i), packed).groupBy("shard").applyInArrow(met_here, packed), "quality-turned") for i in range(PARTS)]
    done(tri)
    whole = functools.reduce(DataFrame.unionByName, parts)

    # a bigram's n is the number of words that it follows
    d2 = discounts(histogram(whole.select("keys").mapInArrow(times(lambda x: runs(swell_sorted(x) >> LOW)[1]), "n bigint, rows bigint")))

    def by_word(batches):
        t, w, p = np.zeros(size, np.int64), np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
        for b in batches:
            for keys in b.column(0).to_pylist():
                two = swell_sorted(keys) >> LOW
                begin, n = runs(two)
                b_, c = (two[begin] >> LOW).astype(np.int64), (two[begin] & LOW_ONE).astype(np.int64)
                t += np.bincount(b_, weights=n, minlength=size).astype(np.int64)
                w += np.bincount(3 * b_ + np.minimum(n, 3) - 1, minlength=3 * size).reshape(size, 3)
                p += np.bincount(c, minlength=size)
        some = np.flatnonzero(t + p)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, p[some], t[some], *w[some].T)], names=["word", "p", "t", "w1", "w2", "w3"])

    # a row for each listed word
    rows = whole.select("keys").mapInArrow(tidy(by_word), ", ".join(f"{x} bigint" for x in ("word", "p", "t", "w1", "w2", "w3")))
    rows = rows.groupBy("word").agg(*[F.sum(x).alias(x) for x in ("p", "t", "w1", "w2", "w3")]).select("word", "p", "t", (F.col("w1") * float(d2[0]) + F.col("w2") * float(d2[1]) + F.col("w3") * float(d2[2])).alias("w")).toArrow()
    p, t, w = np.zeros(size), np.ones(size), np.ones(size)
    at, total = rows["word"].to_numpy(), rows["t"].to_numpy()
    p[at] = rows["p"].to_numpy()
    t[at[total > 0]], w[at[total > 0]] = total[total > 0], rows["w"].to_numpy()[total > 0]
    p = (np.maximum(p - 0.5, 0) + 0.5 * max(1, (p > 0).sum()) / len(p)) / max(1.0, p.sum())
    lower = Lower(listed, p, t, w)
    shared = spark.sparkContext.broadcast(lower.__dict__)

    def second(batches):
        m = revive(Lower, shared.value)
        l, share = m.logs()  # noqa: E741
        for batch in batches:
            for shard, keys, ratio, n, contexts, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, ab = swell_sorted(keys), swell_sorted(contexts)
                begin, times = runs(key >> LOW)
                two = key[begin] >> LOW
                b, c = (two >> LOW).astype(np.int64), (two & LOW_ONE).astype(np.int64)
                p2 = (times - d2[np.minimum(times, 3) - 1] + m.w[b] * m.uni[c]) / m.t[b]
                bonus = np.log1p(swell(ratio, np.float32) / np.repeat(p2, times))
                pairs = np.union1d(two, ab)
                of = np.searchsorted(pairs, two)
                adds = np.zeros(len(pairs))
                adds[of] = np.log(p2) - l[c] - share[b]
                adds[np.searchsorted(pairs, ab)] += swell(back, np.float32)
                hot = swell(n, np.int64) >= limit
                first = float(adds[0]) if len(pairs) and not pairs[0] else None
                columns = squeeze_sorted(key), squeeze(bonus.astype(np.float32)), squeeze_sorted(pairs), squeeze(adds.astype(np.float32)), squeeze_sorted(key[hot]), squeeze((bonus + adds[np.repeat(of, times)])[hot].astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([v], pa.binary()) for v in columns), pa.array([first], pa.float64())], names=["shard", "keys", "bonus", "pairs", "adds", "hot", "whole", "start"])

    model = cut(whole.mapInArrow(tidy(second), "shard int, keys binary, bonus binary, pairs binary, adds binary, hot binary, whole binary, start double"), "quality-model")
    done(*parts)
    shared.destroy()
    return lower, shards, model


def perplexities(docs: DataFrame, lower: Lower, shards: int, model: DataFrame) -> DataFrame:
    """_q_k, nats (mean negative log-probability of a token, null without words) and n (tokens) of each distinct _q_k of docs, as a table.

    Each batch of texts asks each shard of the model once, for the trigrams and
    their last two words together; answers are sums by text, which are added by
    batch first.  The trigrams that are met most often are known to every task.
    """
    spark = docs.sparkSession
    known = model.select("hot", "whole", "start").toArrow()  # HOT n-grams at most
    hot = gathered(known["hot"], swell_sorted, np.uint64), gathered(known["whole"], swell, np.float32)
    # all texts begin with the same pair, which is no trigram's end
    start = sum(x for x in known["start"].to_pylist() if x is not None)
    shared = spark.sparkContext.broadcast(lower.__dict__ | {"hot": hot})
    names = ["shard", "batch", "k", "at", "keys", "base", "n"]

    def ask(batches):
        m = revive(Lower, shared.value)
        (l, back), ids = m.logs(), Words(m.listed)  # noqa: E741
        known, whole = HashIndex(m.hot[0]), m.hot[1]
        for b in batches:
            if not len(b):
                continue
            k = b.column(0).to_numpy()
            x, sizes = ids.ids(b.column(1))
            key, of = trigrams(x, np.repeat(np.arange(len(sizes)), sizes + 3))
            # each trigram's last word and the one before it
            last = (key & LOW_ONE).astype(np.int64), (key >> LOW & LOW_ONE).astype(np.int64)
            base = start + np.bincount(of, weights=l[last[0]] + back[last[1]], minlength=len(k))
            key = (key & LOW_TWO) << LOW | key >> (LOW + LOW)
            at = known.find(key)
            here = at >= 0
            base += np.bincount(of[here], weights=whole[at[here]], minlength=len(k))
            key, of = key[~here], of[~here]
            parts = deal(shard_of(key >> LOW, shards), shards)
            # one of the shards returns what is known here as well
            own, batch, rows = int(k[0] % shards), int(np.int64(xxhash.xxh3_64_intdigest(k.tobytes()) - (1 << 63))), []
            for s in sorted(parts.keys() | {own}):
                i = parts.get(s, np.zeros(0, np.int64))
                some, place = (np.arange(len(k)), of[i]) if s == own else np.unique(of[i], return_inverse=True)
                rows.append((s, batch, k[some].tobytes(), squeeze_sorted(place.astype(np.int64)), squeeze(key[i]), base.tobytes() if s == own else None, sizes.astype(np.int64).tobytes() if s == own else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=names)

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        ks, at = [np.frombuffer(x, np.int64) for x in asked["k"].to_pylist()], [swell_sorted(x, np.int64) for x in asked["at"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in ks])]).astype(np.int64)
        key, total = gathered(asked["keys"], swell, np.uint64), np.zeros(ends[-1])
        of = np.concatenate([np.zeros(0, np.int64), *(x + i for x, i in zip(at, ends, strict=False))])
        for keys, bonus, sought in (("keys", "bonus", key), ("pairs", "adds", key >> LOW)) if len(model) else ():
            found = HashIndex(swell_sorted(model[keys][0].as_py())).find(sought)
            here = found >= 0
            total += np.bincount(of[here], weights=swell(model[bonus][0].as_py(), np.float32)[found[here]], minlength=len(total))
        rows = []
        for batch, k, x, base, n in zip(asked["batch"].to_pylist(), ks, np.split(total, ends[1:-1]), asked["base"].to_pylist(), asked["n"].to_pylist(), strict=False):
            if base is not None:
                rows.append((batch, k.tobytes(), (x + np.frombuffer(base)).tobytes(), n))
            elif x.any():
                rows.append((batch, k[x != 0].tobytes(), x[x != 0].tobytes(), None))
        return pa.table({name: pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i, name in enumerate(("batch", "k", "total", "n"))})

    def add(group: pa.Table) -> pa.Table:
        ks = [np.frombuffer(x, np.int64) for x in group["k"].to_pylist()]
        k, at = np.unique(np.concatenate(ks), return_inverse=True)
        # rows of the same text and id are asked for each by itself
        own = [np.frombuffer(n, np.int64) if n is not None else None for n in group["n"].to_pylist()]
        words, rows = (np.concatenate([f(n) if n is not None else np.zeros(len(x), np.int64) for n, x in zip(own, ks, strict=True)]) for f in (lambda n: n, np.ones_like))
        total = gathered(group["total"], np.frombuffer, np.float64)
        sums = np.bincount(at, weights=total), *(np.bincount(at, weights=x).astype(np.int64) for x in (words, rows))
        return pa.table({name: pa.array(x) for name, x in zip(("_q_k", "total", "words", "rows"), (k, *sums), strict=True)})

    parts = []
    for turn in range(TURNS):
        some = docs.where(F.pmod(F.xxhash64("_q_k"), F.lit(TURNS)) == turn).select("_q_k", "text")
        asked = some.mapInArrow(tidy(ask), "shard int, batch bigint, k binary, at binary, keys binary, base binary, n binary")
        answers = asked.groupBy("shard").cogroup(model.select("shard", "keys", "bonus", "pairs", "adds").groupBy("shard")).applyInArrow(answer, "batch bigint, k binary, total binary, n binary")
        sums = answers.groupBy("batch").applyInArrow(add, "_q_k bigint, total double, words bigint, rows bigint")
        one = sums.groupBy("_q_k").agg(*[F.sum(c).alias(c) for c in ("total", "words", "rows")])
        n = F.expr("words div rows + 1")
        parts.append(cut(one.select("_q_k", F.when(F.col("words") > 0, -F.col("total") / F.col("rows") / n).alias("nats"), n.alias("n")), "quality-scores"))
    shared.destroy()
    done(model)
    return functools.reduce(DataFrame.unionByName, parts)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_q_k (a hash of doc_id and text), doc_id, lang, ppl, threshold, keep."""
    spark = docs.sparkSession
    small_batches(spark)
    trusted = labels.groupBy("doc_id").agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("good and toxic = 0 and doc_id is not null").select("doc_id", (F.crc32(F.concat(F.lit("q"), F.col("doc_id").cast("string"))) % 2).alias("fold"))
    trusted = cut(trusted, "quality-trusted")
    docs = docs.withColumn("_q_k", F.xxhash64("doc_id", "text"))
    ids = trusted.where("fold = 0").select("doc_id")
    some = docs.where("text is not null").where(may_hold(*build_filter(ids, "doc_id"), F.col("doc_id"))).join(ids, "doc_id", "left_semi")
    sample = cut(some.select("_q_k", "text").dropDuplicates(["_q_k"]).select("text"), "quality-training")
    model = train(sample)
    done(sample)
    scored = docs.select("_q_k", "doc_id", "lang").join(perplexities(docs, *model), "_q_k")
    # medians and thresholds cover every trusted document that was not in the training fold; a row for each language
    l = F.coalesce("lang", F.lit("")).alias("l")  # noqa: E741
    held = cut(scored.join(trusted.where("fold = 1"), "doc_id").where("nats is not null").select(l, "nats", "n"), "quality-held")

    def levels(df: DataFrame, value: str, quantile: float, name: str) -> tuple[DataFrame, DataFrame]:
        level = F.percentile_approx(value, quantile, 100_000)
        return df.groupBy("l").agg(level.alias(name), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST).select("l", name), df.agg(level.alias(name))

    def drawn(df: DataFrame) -> DataFrame:
        own, every = levels(held, "nats", 0.5, "middle")
        df = df.join(cut(own, "quality-middles"), "l", "left").withColumn("middle", F.coalesce("middle", every.scalar(), "nats"))
        mean = (F.col("nats") * F.col("n") + F.col("middle") * PRIOR) / (F.col("n") + PRIOR)
        return df.withColumn("ppl", F.when(F.col("nats").isNotNull(), F.exp(F.least(F.lit(50.0), mean)))).drop("middle")

    own, every = levels(drawn(held), "ppl", QUANTILE, "own")
    out = drawn(scored.withColumn("l", l)).withColumn("every", every.scalar()).join(cut(own, "quality-levels"), "l", "left")
    out = out.withColumn("threshold", F.coalesce("own", "every") * MARGIN)
    keep = F.when(F.col("ppl").isNull(), F.lit(False)).otherwise(F.coalesce(F.col("ppl") <= F.col("threshold"), F.lit(True)))
    return out.select("_q_k", "doc_id", "lang", "ppl", "threshold", keep.alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    bad = cut(judge(docs, labels).where("not keep").select("_q_k"), "quality-rejected")
    return without(docs.withColumn("_q_k", F.xxhash64("doc_id", "text")), "_q_k", bad).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_q_k")
