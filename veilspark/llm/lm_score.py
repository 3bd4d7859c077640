"""LM scoring by masked pseudo-likelihood.

A window network predicts each token from SIDE tokens on both of its sides:
shared input rows by word, a weight matrix by position, one tanh layer, and a
softmax in two levels - the most frequent words, shapes of unlisted words and
clusters first, the words of a cluster second.  Both levels start at the
corpus' word frequencies, counted over all documents.  Words beyond the VOCAB
most frequent are spelt: their shape comes from the network, their letters from
a bigram model of bytes, fitted to the counts of all unlisted words.  A
document's score is the sum of the conditional log-probabilities of all its
tokens.

What a network of this size cannot keep is remembered beside it: windows (a
token with SIDE neighbours on both sides) that recur elsewhere in the corpus.
Every window of every text is counted, a document's own occurrence left out, and
the two predictions are mixed half and half; where windows recur, their share of
a text's positions weighs them against the network's score of the whole text.
Texts are dealt to blocks by a hash.  A block asks the shards for the counts of
its distinct windows, each once, so a frequent one reaches its shard once a
block; only counts of recurring windows come back.  This is done in TURNS parts
by the windows' hashes, so that the questions of one part are on disk at once.

Training reads every position of every text once, over ROUNDS rounds.  Equal
texts train once.  Texts are dealt by a hash to shards, whose number follows
from the number of tokens, and are in order of the hash within; each shard
trains a copy of the network, and copies are averaged by slices of their
parameters.  So scores do not depend on how the table is stored.

Defined results: null, empty and blank texts have 0 tokens, log_prob 0 and no
perplexity; contexts beyond a text's ends are a token of their own; each
repeated row is scored; an empty table gives an empty result.  Only doc_id and
text are read, so names cannot clash.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, HashIndex, cut, done, kept, mix64, revive, small_batches, table, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Listed words; those that are outputs of their own; clusters of the rest.
VOCAB, OWN, CLUSTERS = 8192, 40, 64
#: Shapes of unlisted words: kind of characters x length x marks at the end.
SHAPES = 24
FIRST = OWN + SHAPES + CLUSTERS
SIDE, HIDDEN = 2, 16
ROUNDS = 1
BATCH, RATE = 4096, 0.15
#: Rows of outputs that a processor's cache holds.
CACHED = 512
#: Tokens of a shard, about, and the most shards.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 4096
#: Slices of the parameters, and networks that are summed at once.
SLICES, FAN = 16, 64
#: Tokens of a block of texts and windows of a shard, about; parts in which windows are counted.
BLOCK_TOKENS, SHARD_WINDOWS, TURNS = 1_000_000, 2_000_000, 2
#: Bits of a word's hash that windows go by; the others hold the spelling of unlisted words in half precision.
KEEP = np.uint64(0xFFFFFFFFFFFF0000)
#: Distinct words that a counting task holds.
FLUSH = 200_000


# ---- words -------------------------------------------------------------------------------------------------------


def tokens(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A column of texts as distinct words (A-Z lower-cased, if lower), each token's place among them, and each text's number of tokens."""
    column = pc.fill_null(column, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = lists.flatten().dictionary_encode()
    at, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    # white space at a text's ends leaves empty strings
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    kept = np.concatenate([[0], np.cumsum(real[at])]) if len(at) else np.zeros(1, np.int64)
    return words, at[real[at]] if len(at) else at, np.diff(kept[ends])


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some words, and where each word begins (with the end of the last)."""
    words = pa.concat_arrays([words]) if words.offset else words
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), (offsets - offsets[0]).astype(np.int64)


def sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of x by word; words hold a byte at least."""
    return np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else x[:0]


def shapes_of(words: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(pc.utf8_rtrim(words, ".,;:!?"))
    whole = np.diff(bytes_of(words)[1])
    size = np.diff(offsets)
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    run = np.concatenate([[0], np.cumsum(letter)])
    letters = run[offsets[1:]] - run[offsets[:-1]]
    kind = np.where((letters == size) & (size > 0), 0, np.where(letters > 0, 1, 2))
    return kind * 8 + np.minimum(3, size // 3) * 2 + (size != whole)


def hashes_of(words: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(words)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix64(sums(mix64(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + MIX), offsets))


def pairs_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's pairs of neighbouring bytes as first * 256 + second, 0 beyond both ends, and where each word begins."""
    data, offsets = bytes_of(words)
    size = np.diff(offsets)
    padded = np.zeros(len(data) + len(size), np.int64)
    begin = offsets[:-1] + np.arange(len(size))
    padded[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    before = np.concatenate([[0], padded[:-1]])
    return before * 256 + padded, np.concatenate([begin, [len(padded)]])


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all documents; words are lower-cased (A-Z)."""

    def count(batches):
        held, size = [], 0

        def flush():
            all_ = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([all_["word"].combine_chunks(), all_["n_sum"].combine_chunks()], names=["word", "n"])

        for b in batches:
            words, at, _ = tokens(b.column(0))
            n = np.bincount(at, minlength=len(words))
            some = pa.array(n > 0)
            held.append(pa.RecordBatch.from_arrays([words.filter(some), pa.array(n[n > 0], pa.int64())], names=["word", "n"]))
            size += len(held[-1])
            if size >= FLUSH:
                held = [flush()]
                size = len(held[0])
                if size >= FLUSH // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Listed words by rank with their place among the outputs, and the spelling of all others.

    Ids: shapes, then listed words by rank; the id after the last is the place beyond a text's ends.
    """

    def __init__(self, words: list[str], counts: np.ndarray, shape_counts: np.ndarray, pairs: np.ndarray):
        self.words = words
        self.end = SHAPES + len(words)
        # first-level output of each id, and place within a cluster (-1: none)
        self.first = np.concatenate([OWN + np.arange(SHAPES), np.minimum(np.arange(len(words)), OWN)]).astype(np.int64)
        self.second = np.full(self.end, -1, np.int64)
        tail = sorted(range(OWN, len(words)), key=lambda i: (words[i][-2:], words[i]))  # words of like endings share a cluster
        each = max(1, -(-len(tail) // CLUSTERS))
        self.width = each
        for place, i in enumerate(tail):
            self.first[SHAPES + i] = OWN + SHAPES + place // each
            self.second[SHAPES + i] = place % each
        n = np.concatenate([shape_counts, counts]).astype(np.float64) + 0.5
        top = np.bincount(self.first, weights=n, minlength=FIRST)
        self.log_first = np.log(np.maximum(top, 1e-3) / n.sum()).astype(np.float32)
        self.log_second = np.full((CLUSTERS, each), -30, np.float32)
        inner = self.second >= 0
        c = self.first[inner] - OWN - SHAPES
        self.log_second[c, self.second[inner]] = np.log(n[inner] / top[self.first[inner]])
        p = pairs.reshape(256, 256) + 0.01
        self.spell = np.log(p / p.sum(1, keepdims=True)).ravel()
        self.hashes = hashes_of(pa.array(words, pa.string()))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (the first may be ''), and the log-probability of the spelling of those that are not listed."""
        rank = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.string())), -1).to_numpy().astype(np.int64)
        ids, spell = rank + SHAPES, np.zeros(len(rank))
        rare = np.flatnonzero((rank < 0) & pc.not_equal(words, "").to_numpy(zero_copy_only=False))
        if len(rare):
            some = words.take(pa.array(rare))
            ids[rare] = shapes_of(some)
            pairs, begin = pairs_of(some)
            spell[rare] = sums(self.spell[pairs], begin)
        return ids, spell


# ---- network -----------------------------------------------------------------------------------------------------


class Net:
    def __init__(self, lexicon: Lexicon, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.words = small(lexicon.end + 1, HIDDEN)
        self.place = small(2 * SIDE * HIDDEN, HIDDEN) * np.float32(3)
        self.bias = np.zeros(HIDDEN, np.float32)
        # the biases are a last row of the weights: the hidden layer ends with a 1
        self.outer = np.concatenate([small(HIDDEN, FIRST), lexicon.log_first[None]])
        self.inside = np.concatenate([small(CLUSTERS, HIDDEN, lexicon.width), lexicon.log_second[:, None]], axis=1)
        self.top, self.top_bias = self.outer[:-1], self.outer[-1]
        self.inner, self.inner_bias = self.inside[:, :-1], self.inside[:, -1]

    def parts(self) -> list[np.ndarray]:
        return [self.words, self.place, self.bias, self.outer, self.inside]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Net:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input, and the hidden layer with a 1 at its end."""
        x = self.words.take(ctx, axis=0).reshape(len(ctx), -1)
        h = np.ones((len(ctx), HIDDEN + 1), np.float32)
        z = x @ self.place
        z += self.bias
        h[:, :-1] = np.tanh(z, out=z)
        return x, h

    @staticmethod
    def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """The sums of the exponentials of each row, which take the place of z, and what was taken from each row before."""
        top = 0.0
        if z.size and z.max() > 60:  # beyond what single precision holds
            top = z.max(1)
            z -= top[:, None]
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], np.float32), top

    @staticmethod
    def clusters(first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The rows of the tokens that are in a cluster, in the clusters' order, and each cluster's part of them."""
        order = np.argsort(first.astype(np.uint8), kind="stable")
        begin = np.searchsorted(first.take(order), OWN + SHAPES + np.arange(CLUSTERS + 1))
        order, begin = order[begin[0] :], begin - begin[0]
        return order, [(c, slice(begin[c], begin[c + 1])) for c in range(CLUSTERS) if begin[c] < begin[c + 1]]

    def within(self, h: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """The second level's outputs: of each row, those of its own cluster."""
        z = np.empty((len(h), self.inside.shape[2]), np.float32)
        for c, k in parts:
            np.matmul(h[k], self.inside[c], out=z[k])
        return z

    def log_probs(self, ctx: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty(len(ctx))

        def level(z, own):
            mine = z.ravel().take(np.arange(len(z)) * z.shape[1] + own).astype(np.float64)
            total, top = self.exponentials(z)
            return mine - top - np.log(total)

        h = np.empty((len(ctx), HIDDEN + 1), np.float32)
        for i in range(0, len(ctx), CACHED):
            k = slice(i, i + CACHED)
            h[k] = self.hidden(ctx[k])[1]
            out[k] = level(h[k] @ self.outer, first[k])
        rows, parts = self.clusters(first)
        out[rows] += level(self.within(h.take(rows, axis=0), parts), second.take(rows))
        return out

    def step(self, ctx: np.ndarray, first: np.ndarray, second: np.ndarray, seen: list[np.ndarray]) -> None:
        """One step of Adagrad on a batch."""
        n = len(ctx)
        x, h = self.hidden(ctx)

        def slopes(z, own):
            """The outputs' gradients in place of z, but for a factor of each row, and these factors."""
            total, _ = self.exponentials(z)
            z.ravel()[np.arange(len(z)) * z.shape[1] + own] -= total
            return z, (1 / (total * np.float32(n)))[:, None]

        dh, g = np.empty((n, HIDDEN), np.float32), np.zeros_like(self.outer)
        for i in range(0, n, CACHED):
            k = slice(i, i + CACHED)
            z, by = slopes(h[k] @ self.outer, first[k])
            dh[k] = z @ self.top.T * by
            g += (h[k] * by).T @ z
        rows, parts = self.clusters(first)
        some = h.take(rows, axis=0)
        z, by = slopes(self.within(some, parts), second.take(rows))
        d, g_inside = np.empty((len(rows), HIDDEN), np.float32), np.zeros_like(self.inside)
        some *= by
        for c, k in parts:
            np.matmul(z[k], self.inner[c].T, out=d[k])
            np.matmul(some[k].T, z[k], out=g_inside[c])
        dh[rows] += d * by
        dh *= 1 - h[:, :-1] ** 2
        dx = self.place @ dh.T
        self.move(self.place, x.T @ dh, seen[1])
        self.move(self.bias, dh.sum(0), seen[2])
        self.move(self.outer, g, seen[3])
        self.move(self.inside, g_inside, seen[4])  # clusters that the batch does not hold have no gradient
        # rows that the batch does not hold have no gradient
        key = ctx.T.ravel()
        there = np.bincount(key, minlength=len(self.words)) > 0
        rows, key = np.flatnonzero(there), (np.cumsum(there) - 1).take(key)
        dx = dx.reshape(-1, HIDDEN, n)
        g = np.stack([np.bincount(key, weights=dx[:, i].ravel()) for i in range(HIDDEN)], axis=1).astype(np.float32)
        words, past = self.words.take(rows, axis=0), seen[0].take(rows, axis=0)
        self.move(words, g, past)
        self.words[rows], seen[0][rows] = words, past

    @staticmethod
    def move(p: np.ndarray, g: np.ndarray, seen: np.ndarray) -> None:
        """p by its gradient g, which is used up."""
        by = g * g
        seen += by
        g /= np.sqrt(seen, out=by)
        g *= np.float32(RATE)
        p -= g


AROUND = np.array([i for i in range(-SIDE, SIDE + 1) if i])


class Texts:
    """Some texts' ids end to end, with room for what lies beyond their ends."""

    def __init__(self, ids: list[bytes], end: int):
        self.sizes = np.array([len(x) // 2 for x in ids], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.frombuffer(b"".join(ids), np.uint16).astype(np.int64)
        self.padded = np.full(len(self.ids) + SIDE * (len(ids) + 1), end)
        self.place = np.arange(len(self.ids)) + np.repeat(np.arange(1, len(ids) + 1) * SIDE, self.sizes)
        self.padded[self.place] = self.ids

    def contexts(self, at: np.ndarray | slice) -> np.ndarray:
        """Of some positions: the ids at -SIDE..-1 and 1..SIDE."""
        return self.padded.take(self.place[at][:, None] + AROUND)


def masked(key: int, n: int, turn: int, rounds: int) -> np.ndarray:
    """The positions of a text of n tokens that are masked in a round: each in one of the rounds, the first by the text's hash."""
    return np.arange((turn + key) % rounds, n, rounds)


def windows(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's hash with those of its neighbours on both sides, over texts of the given sizes."""
    gap = np.repeat(np.arange(1, len(sizes) + 1) * SIDE, sizes)
    padded = np.full(len(hashes) + SIDE * (len(sizes) + 1), MIX)
    at = np.arange(len(hashes)) + gap
    padded[at] = hashes
    out = np.zeros(len(padded), np.uint64)
    for begin in range(0, len(padded) - 2 * SIDE, CACHED * 32):
        end = min(begin + CACHED * 32, len(padded) - 2 * SIDE)
        for i in range(2 * SIDE + 1):
            out[begin:end] = mix64(out[begin:end] * MIX + padded[begin + i : end + i])
    return out.take(at - SIDE)


# ---- plan --------------------------------------------------------------------------------------------------------


def lexicon(docs: DataFrame) -> Lexicon:
    """Counted over all documents; what reaches the driver is bounded by VOCAB, SHAPES and 256 x 256 pairs of bytes."""
    counted = cut(count_words(docs), "lm-words")
    top = counted.orderBy(F.desc("n"), "word").limit(VOCAB).collect()
    words, counts = [r["word"] for r in top], np.array([r["n"] for r in top], np.int64)
    last = (int(counts[-1]), words[-1]) if words else (0, "")
    rare = counted.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))

    def tally(batches):
        total = np.zeros(SHAPES + 65536, np.int64)
        for b in batches:
            if len(b):
                n, (pairs, begin) = b.column(1).to_numpy(), pairs_of(b.column(0))
                total[:SHAPES] += np.bincount(shapes_of(b.column(0)), weights=n, minlength=SHAPES).astype(np.int64)
                total[SHAPES:] += np.bincount(pairs, weights=np.repeat(n, np.diff(begin)), minlength=65536).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    total = np.zeros(SHAPES + 65536)
    for r in rare.mapInArrow(tidy(tally), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]
    return Lexicon(words, counts, total[:SHAPES], total[SHAPES:])


def encode(docs: DataFrame, shared) -> DataFrame:
    """doc_id, key (a hash of the text), n, ids, spell (log-probability of the spelling of unlisted words), odd (hash and spelling of each unlisted word)."""

    def run(batches):
        lex = revive(Lexicon, shared.value)
        for b in batches:
            words, at, sizes = tokens(b.column(1))
            ids, spell = lex.encode(words)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            spelt = np.concatenate([[0], np.cumsum(spell[at])])
            odd = (hashes_of_all(words) & KEEP) | np.maximum(spell, -60000).astype(np.float16).view(np.uint16).astype(np.uint64)
            rare = ids[at] < SHAPES
            upto = np.concatenate([[0], np.cumsum(rare)])[ends]
            flat, odd = ids[at].astype(np.uint16), odd[at[rare]]
            key = [xxhash.xxh3_128_digest(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            parts = lambda x, ends: pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(sizes, pa.int64()), parts(flat, ends), pa.array(np.diff(spelt[ends])), parts(odd, upto)], names=["doc_id", "key", "n", "ids", "spell", "odd"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, key binary, n bigint, ids binary, spell double, odd binary")


def hashes_of_all(words: pa.Array) -> np.ndarray:
    """hashes_of, with 0 for ''."""
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    out = np.zeros(len(words), np.uint64)
    if real.any():
        out[real] = hashes_of(words.filter(pa.array(real)))
    return out


def opened(lex: Lexicon, block: pa.Table) -> tuple[Texts, np.ndarray, np.ndarray]:
    """A block's texts, and the window and the spelling (0: listed) at each of their positions."""
    texts = Texts(block["ids"].to_pylist(), lex.end)
    odd = np.frombuffer(b"".join(block["odd"].to_pylist()), np.uint64)
    rare = np.flatnonzero(texts.ids < SHAPES)
    hashes, spell = np.append(np.zeros(SHAPES, np.uint64), lex.hashes & KEEP).take(texts.ids), np.zeros(len(texts.ids))
    hashes[rare] = odd & KEEP
    spell[rare] = (odd & ~KEEP).astype(np.uint16).view(np.float16)
    return texts, windows(hashes, texts.sizes), spell


def recurring(texts: DataFrame, shared, total: int) -> DataFrame:
    """block, h, c: of each block of texts(block, copies, ids, odd), windows that occur more than once in the corpus, and how often."""
    shards = max(1, -(-total // (SHARD_WINDOWS * TURNS)))

    def ask(turn: int):
        def run(block: pa.Table) -> pa.Table:
            texts, found, _ = opened(revive(Lexicon, shared.value), block)
            now = found % np.uint64(TURNS) == turn
            h, at = np.unique(found[now], return_inverse=True)
            n = np.bincount(at, weights=np.repeat(block["copies"].to_numpy(), texts.sizes)[now], minlength=len(h)).astype(np.int64)
            shard = h // np.uint64(TURNS) % np.uint64(shards)
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")  # numpy sorts 16 bits in linear time
            ends = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            parts = lambda x: pa.array([x[order[ends[s] : ends[s + 1]]].tobytes() for s in some], pa.binary())
            return pa.table({"shard": pa.array(some, pa.int64()), "block": pa.array(np.full(len(some), block["block"][0].as_py()), pa.int64()), "h": parts(h), "c": parts(n)})

        return run

    def answer(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in rows["h"].to_pylist()]
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(at, weights=np.frombuffer(b"".join(rows["c"].to_pylist()), np.int64)).astype(np.int64)[at]
        out, begin = [], 0
        for h in lists:
            c = n[begin : begin + len(h)]
            begin += len(h)
            out.append((h[c > 1].tobytes(), c[c > 1].tobytes()))
        return pa.table({"block": rows["block"], "h": pa.array([x for x, _ in out], pa.binary()), "c": pa.array([x for _, x in out], pa.binary())})

    parts = []
    for turn in range(TURNS):
        asked = texts.select("block", "copies", "ids", "odd").groupBy("block").applyInArrow(ask(turn), "shard bigint, block bigint, h binary, c binary")
        parts.append(cut(asked.groupBy("shard").applyInArrow(answer, "block bigint, h binary, c binary").where("length(h) > 0"), "lm-memory"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_round(texts: DataFrame, shared, start: np.ndarray, turn: int, rounds: int, shards: int) -> np.ndarray:
    """The shards' networks after their texts' masked positions, averaged by their tokens."""
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast(start)

    def run(batches):
        kept()
        lex = revive(Lexicon, shared.value)
        state: dict[str, object] = {}
        held: list[tuple[bytes, int]] = []
        have, shard = 0, None

        def learn():
            texts = Texts([ids for ids, _ in held], lex.end)
            at = np.concatenate([e + masked(k, n, turn, rounds) for e, n, (_, k) in zip(texts.ends, texts.sizes, held, strict=False)])
            if not len(at):
                return
            order = np.random.default_rng(state["n"]).permutation(at)
            # batches of BATCH or a little less, so that none is left over
            for k in np.array_split(order, -(-len(at) // BATCH)):
                y = texts.ids[k]
                state["net"].step(texts.contexts(k), lex.first[y], lex.second[y], state["seen"])
            state["n"] += len(at)

        def slices():
            parts = np.array_split(state["net"].flat().astype(np.float64) * state["n"], SLICES)
            return pa.RecordBatch.from_arrays([pa.array([shard] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([state["n"]] * SLICES, pa.int64())], names=["shard", "slice", "v", "n"])

        for b in batches:
            for of, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != shard:
                    if have:
                        learn()
                    if shard is not None and state["n"]:
                        yield slices()
                    net = Net(lex).load(given.value)
                    state |= {"net": net, "seen": [np.full(p.shape, 1e-4, np.float32) for p in net.parts()], "n": 0}
                    held, have, shard = [], 0, of
                held.append((ids, key[0]))
                have += len(ids) // 2
                if have >= 64 * BATCH:
                    learn()
                    held, have = [], 0
        if have:
            learn()
        if shard is not None and state["n"]:
            yield slices()

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for v in group.sort_values("shard")["v"]:
            total = total + np.frombuffer(v, np.float64)
        return pd.DataFrame({"shard": [key[0]], "slice": [key[1]], "v": [total.tobytes()], "n": [int(group["n"].sum())]})

    schema = "shard bigint, slice int, v binary, n bigint"
    dealt = texts.select((F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("bigint") % shards).alias("shard"), "key", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "key")
    nets = cut(dealt.mapInArrow(tidy(run), schema), "lm-nets")
    left = shards
    while left > 1:
        nets = cut(nets.groupBy(F.floor(F.col("shard") / FAN).alias("shard"), "slice").applyInPandas(add, schema), "lm-nets")
        left = -(-left // FAN)
    given.destroy()
    rows = sorted(nets.collect(), key=lambda r: r["slice"])  # SLICES rows: one network
    return np.concatenate([np.frombuffer(r["v"], np.float64) / r["n"] for r in rows]).astype(np.float32) if rows else start


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, pseudo_perplexity of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    lex = lexicon(docs)
    shared = spark.sparkContext.broadcast(lex.__dict__)  # VOCAB words
    encoded = cut(encode(docs, shared), "lm-ids")
    one = encoded.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "ids", "spell", "odd")])
    texts = cut(one, "lm-texts")
    whole, encoded = encoded, cut(encoded.select("doc_id", "key", "n"), "lm-documents")
    done(whole)
    total = texts.agg(F.sum("n")).first()[0] or 0
    shards = min(MAX_SHARDS, -(-total // SHARD_TOKENS))
    flat = Net(lex).flat()
    for i in range(rounds if shards else 0):
        flat = train_round(texts, shared, flat, i, rounds, shards)
    given = spark.sparkContext.broadcast(flat)
    texts = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // BLOCK_TOKENS)))))
    memory = recurring(texts, shared, total)

    def run(block: pa.Table, memory: pa.Table) -> pa.Table:
        kept()
        lex = revive(Lexicon, shared.value)
        net = Net(lex).load(given.value)
        texts, found, spell = opened(lex, block)
        lp = np.empty(len(texts.ids))
        for i in range(0, len(lp), 8192):
            k = slice(i, i + 8192)
            lp[k] = net.log_probs(texts.contexts(k), lex.first[texts.ids[k]], lex.second[texts.ids[k]])
        by_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[texts.ends])
        at = HashIndex(np.frombuffer(b"".join(memory["h"].to_pylist()), np.uint64)).find(found)
        more = np.append(np.frombuffer(b"".join(memory["c"].to_pylist()), np.int64), 1)[at] - 1
        # half of each prediction is the memory's: nothing, but where a window recurs
        half = np.log(2.0)
        mixed = np.where(at >= 0, np.log(np.exp(lp + spell) + more / (more + 1)) - half, 0.0)
        share = by_text(at >= 0) / texts.sizes
        alone = by_text(lp) + block["spell"].to_numpy() - texts.sizes * half
        return pa.table({"key": block["key"], "log_prob": pa.array((1 - share) * alone + by_text(mixed))})

    scored = texts.select("block", "key", "ids", "spell", "odd").groupBy("block").cogroup(memory.groupBy("block")).applyInArrow(run, "key binary, log_prob double")
    scored = cut(scored, "lm-scores")
    given.destroy()
    shared.destroy()
    out = encoded.join(scored, "key", "left").withColumn("log_prob", F.coalesce("log_prob", F.lit(0.0)))
    mean = F.when(F.col("n") > 0, F.col("log_prob") / F.col("n"))
    return out.select("doc_id", F.col("n").alias("n_tokens"), "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("pseudo_perplexity"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
