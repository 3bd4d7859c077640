"""Document fingerprints by winnowing, in built-in expressions only.

A text's units are its words (runs of characters other than ASCII white
space); those of a text with fewer than K words, or with more than LONG code
points to a word, are its code points, as scripts without blanks need it.
Rolling hashes of K units, as array expressions by doubling; in each
window of W hashes the smallest is chosen, with ties to the rightmost; its
position is kept.  Any passage of K + W - 1 units that two texts share
therefore leaves a common fingerprint in both.  Short texts, with fewer than
4 W hashes, keep all of them, and those with fewer than FEW units also the hash
of each unit, so that their likeness has more values than 0 and 1.  A hash and
its position travel as one long: the 38 upper bits are the hash, the 26 lower
ones count down from the text's start, so that the minimum of longs is the
rightmost minimum; positions beyond 2^26 units are all told as that.

Defined results: null and empty texts have n_chars 0 and fingerprint ''.
Likeness is the Jaccard coefficient of the sets of
hashes, and 1 for two empty sets.  Null ids come before all others; equal ids
are ordered by text; each repeated row is a document.  A table with one row is
its own next document.  Only doc_id and text are read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_SQL, table

#: Units in a hash (a power of two) and hashes in a window (a power of two).
K, W = 4, 8
#: Units of a text that also keeps their single hashes; code points to a word of a text whose units they are.
FEW, LONG = 12, 16
POS_BITS = 26
LOW = (1 << POS_BITS) - 1
#: Documents in a window partition, about.
BUCKET = 400


def _tail(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def _head(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def _doubled(df: DataFrame, name: str, to: int, f) -> DataFrame:
    """Column name becomes f folded over each run of `to` neighbours (a power of two; fewer elements: none), by doubling."""
    step = 1
    while step < to:
        df = df.withColumn(name, F.zip_with(_head(F.col(name), step), _tail(F.col(name), step), f))
        step *= 2
    return df


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column out: the chosen hashes as array<bigint>, in order of the text.

    Every step is a column of its own: the optimizer would otherwise copy a
    step's expression into each place that names it.
    """
    w, h, n, g, m = (f"_{out}_{x}" for x in "whngm")
    none = F.array().cast("array<bigint>")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(w, F.filter(F.split(whole, SPACE_SQL), lambda x: x != ""))
    df = df.withColumn(w, F.when((F.size(w) >= K) & (F.char_length(whole) <= F.size(w) * LONG), F.col(w)).otherwise(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0))))
    df = df.withColumn(n, F.size(w))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.when(F.col(n) >= K, F.col(h)).otherwise(none))
    df = _doubled(df, g, K, lambda a, b: F.xxhash64(a, b))
    marked = lambda a: F.transform(a, lambda x, i: x.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.lit(LOW) - F.least(i, F.lit(LOW))))
    df = df.withColumn(g, marked(F.col(g)))
    df = df.withColumn(m, F.when(F.size(g) >= 4 * W, F.col(g)).otherwise(none))
    df = _doubled(df, m, W, lambda a, b: F.least(a, b))
    chosen = F.when(F.size(g) >= 4 * W, F.array_distinct(m)).when(F.col(n) < FEW, F.concat(g, marked(F.col(h)))).otherwise(F.col(g))
    return df.withColumn(out, chosen).drop(w, h, n, g, m)


def hashes_of(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda v: v.bitwiseAND(F.lit(~LOW))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets of hashes."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(fp: Column) -> Column:
    """'hash@position' of each chosen hash, joined by blanks."""
    return F.array_join(F.transform(fp, lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, POS_BITS))), F.lit("@"), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("string"))), " ")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """doc_id, text, next_text, bucket, ghost: each document with the next one's text, ascending doc_id, the last with the first's.

    One shuffle, by ranges of ids: quantiles of doc_id cut it into segments,
    each split evenly into buckets of about bucket_rows.  A bucket ends with a
    copy (ghost) of the next bucket's first document; ghosts are marked.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = 256
    # one row whatever the input: counts and at most 257 quantiles
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 20000).alias("q")).first()
    q = sorted(set(stats["q"] or []))
    per = max(1, -(-stats["n"] // (bucket_rows * max(1, len(q)))))
    bounds = F.array(*[F.lit(x).cast("long") for x in q]) if q else F.array().cast("array<bigint>")
    low = F.get(bounds, F.col("_seg"))
    high = F.coalesce(F.get(bounds, F.col("_seg") + 1), low + 1)
    docs = docs.withColumn("_seg", F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))) - 1)
    within = F.floor((F.col("doc_id") - low).cast("double") * per / (high - low).cast("double"))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-2)).when(F.col("_seg") < 0, F.lit(-1)).otherwise(F.col("_seg").cast("long") * per + F.least(within, F.lit(per - 1)))).drop("_seg")
    # the first document of each bucket, handed to the bucket before it: within a segment, and from one segment, of which
    # there are 259 at most, to the next
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first")).withColumn("seg", F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.floor(F.col("bucket") / per)))
    last = firsts.groupBy("seg").agg(F.max("bucket").alias("last"))
    over = Window.orderBy("seg")
    last = last.select("seg", F.coalesce(F.lag("last").over(over), F.max("last").over(Window.partitionBy())).alias("before"))
    firsts = firsts.withColumn("lag", F.lag("bucket").over(Window.partitionBy("seg").orderBy("bucket"))).join(F.broadcast(last.limit(cuts + 3)), "seg")
    firsts = firsts.select(F.coalesce("lag", "before").alias("to"), F.col("bucket").alias("of"), "first")
    heads = docs.join(firsts, (docs["bucket"] == firsts["of"]) & docs["doc_id"].eqNullSafe(firsts["first"])).groupBy("to", "first").agg(F.min("text").alias("text"))
    ghosts = heads.select(F.col("first").alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    return docs.withColumn("ghost", F.lit(0)).unionByName(ghosts).withColumn("next_text", F.lead("text").over(order))


def edit(text: Column, next_text: Column) -> Column:
    """text, its last quarter replaced by as many (or all) of the next text's first characters."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.left(next_text, quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and likenesses."""
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, edit(F.col("text"), F.col("next_text"))).otherwise(F.lit("")))
    rows = winnow(winnow(rows, "text", "fp"), "edited", "efp")
    rows = rows.select("doc_id", "text", "bucket", "ghost", "fp", "efp", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    # dealt and sorted as the window before: no further shuffle
    rows = rows.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text"))).where("ghost = 0")
    rows = rows.withColumn("s", hashes_of(F.col("fp"))).withColumn("es", hashes_of(F.col("efp"))).withColumn("ns", hashes_of(F.col("nfp")))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("ns")).alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
