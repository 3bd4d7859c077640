"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document's set holds its distinct SHINGLE-word shingles, as 64-bit hashes,
whose equality is taken for theirs; equal sets are one class.  Tokens are
ordered light before heavy and by hash within; two sets of a Jaccard
coefficient of PERCENT share a token of their prefixes.  Classes of identical
prefix and size form a group; groups are joined on prefix tokens, filtered by
size and position, expanded to classes and verified on whole sets.

Heavy tokens (found in a hash sample; they only affect the order, never the
result) and any other token that more than BLOCK groups turn out to share make
large blocks, whose pairs would grow with the square.  Such a block is
first joined as a star: one member with every other.  After the
verified links have been made components, ROUNDS more rounds of stars, each of
PIVOTS members with all of other components, gather what is alike; then only
pairs between different components remain to be tried, each at the first such
token that its members share.  Groups with several classes are treated in the
same way.  No block is gathered in a task: all joins are equi-joins that can
spill and be split.

The result is exact.  Pairs are met only if sizes, positions and parities of
64 parts of the sets allow a link, and verified only if those of 512 parts do.
As these are too few for long texts, parities of as many parts as a set has
tokens, twice to four times, are compared before whole sets travel for a pair.
Many texts that share frequent shingles
without being alike still cost such a look for each pair; that is the limit of
a prefix filter.  Text is
shuffled only for classes that are in a candidate pair (beyond a million of
them, all of it once).  Intermediate tables lie in the shared folder and are
removed when nothing is computed from them any more.

Defined results: null and empty texts, and texts without words, have no
shingles and are linked with nothing; null ids are linked but name no
component; rows of equal text link, whatever their ids.  An empty table gives
an empty result.  Only doc_id and text are read by links(); names cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, ascii_words, cut, done, mix64, small_batches, table, tidy
from .url_filter import build_filter, may_hold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
#: Least Jaccard coefficient, in hundredths.
PERCENT = 80
#: One document in SAMPLE is looked through for heavy tokens, which are seen HEAVY times there; the most frequent LISTED
#: of them (1 MB) are broadcast.  Any that are not show as large blocks.
SAMPLE, HEAVY, LISTED = 32, 3, 1 << 17
#: Groups in a block that are compared with each other at once.
BLOCK = 64
#: Rounds of further stars in the blocks that are still open, and members of a block that a round compares with the others.
ROUNDS, PIVOTS = 2, 4
#: 64-bit words of a set's parities.
WIDE = 8
#: Words whose hashes a worker remembers.
CACHE = 1 << 16


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * MIX + h[i : i + len(out)])
    return np.unique(out)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """So many first tokens of which two sets must share one: all but the least possible overlap, and one."""
    return n - -(-n * percent // 100) + 1


def heavy_tokens(docs: DataFrame) -> np.ndarray:
    def count(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(0).to_pylist()]
            token, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    seen = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(count), "token bigint, n bigint")
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY).orderBy(F.desc("n"), "token").limit(LISTED)
    # as a table, as shuffle files are given back with its end
    top = cut(top.select("token"), "join-heavy")
    out = np.sort(np.array([r["token"] for r in top.collect()], np.int64).view(np.uint64))
    done(top)
    return out


SIGNATURES = "doc_id bigint, k bigint, n bigint, u bigint, g bigint, x bigint, w array<bigint>, light array<bigint>, heavy array<bigint>"


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """A row for each document: k (a hash of doc_id and text), set size n, class u, group g (null for empty sets), parities x and w, light and heavy tokens of the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs))

    def sign(batches):
        hashes, heavy = WordHashes(), shared.value
        names = [x.split()[0] for x in SIGNATURES.split(", ")]
        for b in batches:
            n, u, g, x, w, low, high = [], [], [], [], [], [], []
            for text in b.column(2).to_pylist():
                # in order as signed numbers, as SQL compares tokens
                s = np.sort(shingles(text, hashes).view(np.int64)).view(np.uint64)
                n.append(len(s))
                if not len(s):
                    u.append(None), g.append(None), x.append(0), w.append(None), low.append([]), high.append([])
                    continue
                p = prefix_size(len(s), percent)
                is_heavy = np.zeros(len(s), bool)
                if len(heavy):
                    at = np.searchsorted(heavy, s)
                    is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == s
                light = s[~is_heavy][:p]
                rest = s[is_heavy][: p - len(light)]
                digest = lambda *x: int(np.int64(xxhash.xxh3_64_intdigest(b"".join(y.tobytes() for y in x)) - (1 << 63)))
                u.append(digest(s))
                odd = np.packbits((np.bincount((s & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1).astype(bool), bitorder="little").view(np.int64)
                w.append(odd)
                x.append(int(np.bitwise_xor.reduce(odd)))
                g.append(digest(np.array([len(s)]), light, rest))
                low.append(light.view(np.int64)), high.append(rest.view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, k) for v, k in zip((n, u, g, x, w, low, high), kinds, strict=True))], names=names)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text").mapInArrow(tidy(sign), SIGNATURES)


def can_link(a: str, b: str, percent: int, parities: Callable[..., str] | None = None) -> str:
    """SQL: sizes and positions allow the link, if tokens a and b are the first that the two sets share, and so do parities."""
    x, test = ("w", parities) if parities else ("x", near)
    m, o = 100 + percent, percent
    return f"""least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {o}
               and least({a}.n - {a}.pos, {b}.n - {b}.pos) * {m} >= ({a}.n + {b}.n) * {o} and {test(f"{a}.{x}", f"{b}.{x}", f"{a}.n + {b}.n", percent)}"""


def near(x: str, y: str, sizes: str, percent: int) -> str:
    """SQL: two sets may link by their parities, of the numbers of tokens in each of 64 parts.

    A token that only one set has changes one parity, so as many tokens as
    parities differ are not shared at least.  Unknown parities allow all.
    """
    return f"coalesce(bit_count({x} ^ {y}) * {100 + percent} <= ({sizes}) * {100 - percent}, true)"


def wide(a: str, b: str, sizes: str, percent: int) -> str:
    """SQL: two sets may link by their parities in WIDE words."""
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(WIDE))
    return f"({differ}) * {100 + percent} <= ({sizes}) * {100 - percent}"


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens in each of some parts, two to four times as many as a set has tokens, as 64-bit words."""
    parts = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many of their parities two sets differ, in the coarser division of the two; its parts are pairs of the finer one's."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs(a, ka, b, kb) of classes whose whole sets, taken from the documents ka and kb, link.

    Only parities travel at first, which most pairs that do not link fail, then
    sets as 32-bit halves of their hashes.  Pairs that these leave nearer to the
    limit than chance collisions could matter are decided by whole hashes.
    """
    pairs = cut(pairs, "join-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    tried = compare(pairs, docs, percent, np.uint32)
    done(pairs)
    sure, unsure = tried.where("linked").select("a", "b"), tried.where("linked is null").select("a", "ka", "b", "kb")
    return sure if unsure.isEmpty() else sure.unionByName(compare(unsure, docs, percent, np.uint64).where("linked").select("a", "b"))


def compare(pairs: DataFrame, docs: DataFrame, percent: int, kind: type) -> DataFrame:
    """pairs with linked: whether the sets, hashes cut to kind, link; null if collisions might decide that.  As a table.

    Those whose parities rule out a link are left out.
    """
    wanted = cut(pairs.select(F.explode(F.array("ka", "kb")).alias("k")).distinct(), "join-wanted")
    # a filter keeps most other texts out of the join
    some = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text")
    some = some.where(may_hold(*build_filter(wanted, "k"), F.col("k"))).join(wanted, "k", "left_semi")

    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            own = [shingles(t, hashes) for t in b.column(1).to_pylist()]
            out = [pa.array(map(len, own), pa.int64()), pa.array([parities(s).tobytes() for s in own], pa.binary()), pa.array([np.unique(s.astype(kind)).tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["k", "n", "p", "s"])

    whole = cut(some.mapInArrow(tidy(sets), "k bigint, n bigint, p binary, s binary").dropDuplicates(["k"]), "join-sets")
    used, close, needed = [wanted, whole], pairs, whole
    # whole hashes are asked for when parities have been
    if kind is np.uint32:
        close = may_link(pairs, whole, percent)
        left = cut(close.select(F.explode(F.array("ka", "kb")).alias("k")).distinct(), "join-wanted")
        needed = whole.where(may_hold(*build_filter(left, "k"), F.col("k")))
        used += [close, left]
    both = close.join(needed.select(F.col("k").alias("ka"), F.col("s").alias("sa")), "ka").join(needed.select(F.col("k").alias("kb"), F.col("s").alias("sb")), "kb").select("a", "ka", "b", "kb", "sa", "sb")

    def check(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                over = 100 * common - percent * (len(x) + len(y) - common)
                # a collision moves over by 200 at most; far fewer than these are to be expected
                near = 200 * (1 + len(y) ** 2 // 2**28) if kind is np.uint32 else 0
                linked.append(None if abs(over) < near else over >= 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked, pa.bool_())], names=["a", "ka", "b", "kb", "linked"])

    out = cut(both.mapInArrow(tidy(check), "a bigint, ka bigint, b bigint, kb bigint, linked boolean"), "join-tried")
    done(*used)
    return out


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets may link by their sizes n and parities p.  As a table."""
    side = lambda x: sets.select(F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"))
    both = pairs.join(side("a"), "ka").join(side("b"), "kb").select("a", "ka", "b", "kb", "na", "pa", "nb", "pb")

    def check(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(4, 8)), strict=True)
            stay = [differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) * (100 + percent) <= (n + m) * (100 - percent) for n, x, m, y in rows]
            yield b.select(["a", "ka", "b", "kb"]).filter(pa.array(stay, pa.bool_()))

    return cut(both.mapInArrow(tidy(check), "a bigint, ka bigint, b bigint, kb bigint"), "join-close")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of edges(a, b).

    Each partition first shrinks its own edges to stars; then large-star and
    small-star steps alternate until nothing changes.
    """

    def shrink(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(root)]
        rows = [r for r in rows if r[0] != r[1]]
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["a", "b"])

    links = cut(edges.mapInArrow(shrink, "a bigint, b bigint").distinct(), "components")
    while True:
        # done when each child has one parent that is no child itself
        many = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        deep = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        if many.unionByName(deep).isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")  # large star
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b")  # small star
        links = cut(links.distinct().mapInArrow(tidy(shrink), "a bigint, b bigint").distinct(), "components")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents (with class u), and the classes: u, id and k of the first document, component c."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs, percent), "join-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("k").alias("k")))
    some = [F.first(c).alias(c) for c in ("n", "g", "w")]
    classes = cut(signed.where("u is not null").groupBy("u").agg(first.alias("f"), *some).select("u", "n", "g", "w", "f.id", "f.k"), "join-classes")
    # a group's prefix is taken from one document; parities are known of a group of one class
    carriers = signed.where("u is not null").groupBy("g").agg(F.min_by(F.struct("n", "x", "light", "heavy"), F.struct("u", "k")).alias("c"), (F.min("u") == F.max("u")).alias("one"))
    carriers = cut(carriers.select("g", "c.n", F.expr("if(one, c.x, null)").alias("x"), "c.light", "c.heavy"), "join-carriers")
    whole, signed = signed, cut(signed.select("doc_id", "k", "n", "u"), "join-documents")
    done(whole)
    # tokens are met without sizes and parities: most are found once
    light = carriers.select("g", F.posexplode("light").alias("pos", "token"))
    light = light.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("m > 1")
    light = cut(light, "join-light")
    small = light.where(F.col("m") <= BLOCK).select("token", "g", "pos").join(carriers.select("g", "n", "x"), "g")
    small = cut(small, "join-small")
    pairs = small.alias("x").join(small.alias("y"), F.expr(f"x.token = y.token and x.g < y.g and {can_link('x', 'y', percent)}")).selectExpr("x.g as ga", "y.g as gb").distinct()

    heavy = carriers.where(F.size("heavy") > 0).select("g", "n", "x", F.size("light").alias("at"), F.posexplode("heavy").alias("i", "token"))
    large = light.where(F.col("m") > BLOCK).select("token", "g", "pos").join(carriers.select("g", "n", "x"), "g").select("token", "g", "n", "x", "pos")
    blocks = large.unionByName(heavy.select("token", "g", "n", "x", (F.col("at") + F.col("i")).alias("pos")))
    blocks = cut(blocks.dropDuplicates(["token", "g"]), "join-blocks")
    done(light, carriers)
    pivot = cut(blocks.groupBy("token").agg(F.min(F.struct("g", "n", "x")).alias("p")), "join-pivots")
    stars = blocks.join(pivot, "token").where("g != p.g").where(near("x", "p.x", "n + p.n", percent)).withColumn("pg", F.col("p.g")).select(F.least("g", "pg").alias("ga"), F.greatest("g", "pg").alias("gb")).distinct()

    side = lambda x: classes.select(F.col("g").alias(f"g{x}"), F.col("u").alias(x), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"))
    groups = cut(pairs.unionByName(stars).distinct(), "join-groups-tried")
    done(small, pivot)
    tried = groups.join(side("a"), "ga").join(side("b"), "gb").where(wide("wa", "wb", "na + nb", percent)).select("a", "ka", "b", "kb")
    # groups of several classes: their first class with each other
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("k").alias("k"), F.col("u").alias("u"), F.col("w").alias("w")))
    several = cut(classes.groupBy("g").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.col("f.u").alias("a"), F.col("f.k").alias("ka"), F.col("f.w").alias("wa")), "join-several")
    member = classes.join(several, "g")
    within = member.where("u != a").where(wide("w", "wa", "n + n", percent)).select("a", "ka", F.col("u").alias("b"), F.col("k").alias("kb"))
    good = verify(tried.unionByName(within), docs, percent)
    done(groups)
    found = components(good)

    # what the stars left open: pairs of one block in different components.  All tokens that such a pair shares are open
    many = member.select(F.col("g").alias("token"), "u", "k", "n", "w", F.lit(0).alias("pos"))
    rows = blocks.select("token", "g", "pos").join(classes.select("g", "u", "k", "n", "w"), "g").select("token", "u", "k", "n", "w", "pos").unionByName(many)

    def opened(rows: DataFrame) -> DataFrame:
        rows = rows.join(found.withColumnRenamed("node", "u"), "u", "left").withColumn("c", F.coalesce("root", "u")).drop("root")
        open_ = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("token")
        return cut(rows.join(open_, "token", "left_semi"), "join-open")

    def joined(late: DataFrame) -> DataFrame:
        known = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(known.unionByName(late))

    rows = opened(rows)
    allowed = f"x.c != y.c and {can_link('x', 'y', percent, wide)}"
    for turn in range(ROUNDS):
        # other members each time, about PIVOTS of a block
        seed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
        pivots = cut(rows.join(seed, "token").where(f"pmod(xxhash64(u, {turn}), m) < {PIVOTS}").drop("m"), "join-pivots")
        star = pivots.alias("x").join(rows.alias("y"), F.expr(f"x.token = y.token and {allowed}"))
        star = star.selectExpr("if(x.u < y.u, x.u, y.u) as a", "if(x.u < y.u, x.k, y.k) as ka", "if(x.u < y.u, y.u, x.u) as b", "if(x.u < y.u, y.k, x.k) as kb").distinct()
        late = verify(star, docs, percent)
        done(pivots)
        if late.isEmpty():
            break
        found, before = joined(late), rows
        rows = opened(rows.drop("c"))
        done(before)
    order = rows.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("shared"))
    rows = rows.join(order, "u")
    cross = rows.alias("x").join(rows.alias("y"), F.expr(f"x.token = y.token and x.u < y.u and {allowed} and get(array_intersect(x.shared, y.shared), 0) = x.token"))
    late = verify(cross.selectExpr("x.u as a", "x.k as ka", "y.u as b", "y.k as kb").distinct(), docs, percent)
    if not late.isEmpty():
        found = joined(late)
    done(blocks)
    classes = classes.select("u", "id", "k").join(found.withColumnRenamed("node", "u"), "u", "left")
    return signed, cut(classes.select("u", "id", "k", F.coalesce("root", "u").alias("c")), "join-found")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, itself included)."""
    signed, classes = links(docs, percent)
    # small tables and no aggregate above: adaptive execution splits a large component or class
    first = cut(classes.groupBy("c").agg(F.min("id").alias("first")), "join-first")
    first = cut(classes.select("u", "c").join(first, "c").select("u", "first"), "join-named")
    return signed.select("doc_id", "n", "u").join(first, "u", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("u").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the smallest id; rows that are linked with nothing stay."""
    signed, classes = links(docs, percent)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("k").alias("k")))
    kept = classes.groupBy("c").agg(first.alias("f")).select("f.k", F.lit(True).alias("stays"))
    rows = signed.where("u is not null").groupBy("k").agg(F.count(F.lit(1)).alias("rows")).join(kept, "k", "left")
    # all other rows pass untouched
    verdicts = cut(rows.where("stays is null or rows > 1").select(F.col("k").alias("_jj_k"), F.col("stays").alias("_jj_stays")), "join-verdicts")
    docs = docs.withColumn("_jj_k", F.xxhash64("doc_id", "text"))
    hit = may_hold(*build_filter(verdicts, "_jj_k"), F.col("_jj_k"))
    judged = docs.where(hit).join(verdicts.withColumn("_jj_met", F.lit(True)), "_jj_k", "left")
    # a kept row that is repeated stays once
    once = judged.where("_jj_stays").dropDuplicates(["_jj_k"])
    out = [docs.where(~hit), judged.where("_jj_met is null"), once]
    return out[0].drop("_jj_k").unionByName(out[1].select(*out[0].drop("_jj_k").columns)).unionByName(out[2].select(*out[0].drop("_jj_k").columns))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
