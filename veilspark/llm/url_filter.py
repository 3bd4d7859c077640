"""URL filters: a blocked Bloom filter of listed URLs ahead of an exact hash join.

Built-in expressions only.  A listed entry is a canonical URL prefix
``host/path...``; it holds for its host and all subdomains and for paths that
start with its path.  A page's candidates are its host's label suffixes times
its path's prefixes of the lengths that occur in the list; candidates that the
filter lets through are joined to the list, which removes false positives.

Defined results: a null URL or one without ``://`` has host and path ''; no
entry fits it, so it is allowed.  Repeated pages each get their row.  Empty
tables give empty results.  Other columns of the pages are not read, so names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, canonical URL prefix) of the contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Listed spam hosts, blocked where no rule fits.  filter_urls() also takes a list as a table, of any length.
LISTED = ["spam-farm.example.org/", "cheap-pills.example.com/", "casino-win.example.com/", "free-bets.example.com/", "ads-track.example.com/", "adult-x.example.net/"]

#: A block is eight 64-bit words; a key sets one bit in each.
WORDS = 8
#: 16 bits a key.  A filter is broadcast, so it has a bound: 2^15 blocks of 64 bytes, 2 MiB, a million keys.
#: Beyond that there is none, and the exact join, a plain shuffle, gets every row.
KEYS_PER_BLOCK, MAX_BLOCKS = 32, 1 << 15


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bit(key_hash: Column, word: int) -> Column:
    """The bit that a key sets in a word of its block: six bits of a hash of its own for each word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key_hash, F.lit(word)), F.lit(64)).cast("int"))


def build_filter(keys: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """One row with the filter's words as array<bigint>, and its number of blocks; none beyond MAX_BLOCKS."""
    n = keys.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    if blocks > MAX_BLOCKS:
        return None, 0
    h = keys.select(F.xxhash64(key).alias("h"))
    block = F.pmod(F.col("h"), F.lit(blocks)).cast("int")
    bits = h.select(F.explode(F.array(*[F.struct((block * WORDS + w).alias("at"), _bit(F.col("h"), w).alias("bit")) for w in range(WORDS)])).alias("x")).select("x.*")
    every = keys.sparkSession.range(blocks * WORDS).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bit"))
    words = bits.unionByName(every).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    # at most MAX_BLOCKS * 8 rows, whatever the list's length
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("words"))
    return cut(one, "bloom"), blocks


def may_hold(words: DataFrame | None, blocks: int, key: Column) -> Column:
    if words is None:
        return F.lit(True)
    h = F.xxhash64(key)
    base = F.pmod(h, F.lit(blocks)).cast("int") * WORDS
    out = F.lit(True)
    for w in range(WORDS):
        out = out & (F.get(words.scalar(), base + w).bitwiseAND(_bit(h, w)) != 0)
    return out


def without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs whose column key is not in the one column of keys: only rows that a filter of keys lets through are shuffled."""
    hit = may_hold(*build_filter(keys, key), F.col(key))
    return docs.where(~hit).unionByName(docs.where(hit).join(keys, key, "left_anti").select(*docs.columns))


def judge(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """For distinct (host, path) of urls: the longest fitting entry of listed(key, action, rank), rank 0 ahead of 1.

    Returns host, path, key, action, rank of those that an entry fits.
    """
    keys = listed.select("key").distinct()
    words, blocks = build_filter(keys, "key")
    at = F.locate("/", F.col("key"))
    # as many values as a path has lengths: a bounded set, and one row
    lengths = keys.agg(F.array_sort(F.collect_set(F.length("key") - at + 1)).alias("lengths"))
    labels = F.split("host", r"\.")
    pairs = urls.select("host", "path").where("host <> ''").distinct().withColumn("lengths", lengths.scalar())
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    found = pairs.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("key"))
    found = found.where(may_hold(words, blocks, F.col("key")))
    exact = found.join(listed, "key")
    best = F.max_by(F.struct("key", "action", "rank"), F.struct(-F.col("rank"), F.length("key"), F.col("key")))
    return exact.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.*")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: list[str] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (the listed URL that blocks a page without a rule).

    rules are (action, URL prefix); listed are URL prefixes to block, as a list or a DataFrame with one column ``key``.
    """
    spark = pages.sparkSession
    entries = spark.createDataFrame([(k, a, 0) for a, k in rules], "key string, action string, rank int")
    more = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    entries = cut(entries.unionByName(more.where("key like '%/%'").distinct().select("key", F.lit("block").alias("action"), F.lit(1).alias("rank"))), "url-entries")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # urls without a host, of which there may be very many, can fit no entry
    hosted = urls.where("host <> ''").join(judge(urls, entries), ["host", "path"], "left")
    none = urls.where("host = ''").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("action", "string"), ("rank", "int"))])
    out = hosted.unionByName(none)
    return out.select(
        "page_id", "host", "path",
        F.when(F.col("rank") == 0, F.col("key")).alias("rule"),
        F.coalesce("action", F.lit("allow")).alias("verdict"),
        F.when(F.col("rank") == 1, F.col("key")).alias("listed"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES, LISTED)


ORACLE = """
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
  from pages),
e(key, action, rank) as (values ('com/en/', 'block', 0), ('example.com/en/7', 'allow', 0), ('net/de/', 'block', 0),
  ('example.net/de/8', 'block', 0), ('org/es/', 'block', 0), ('spam-farm.example.org/', 'block', 1), ('cheap-pills.example.com/', 'block', 1),
  ('casino-win.example.com/', 'block', 1), ('free-bets.example.com/', 'block', 1), ('ads-track.example.com/', 'block', 1), ('adult-x.example.net/', 'block', 1)),
s as (select *, left(key, strpos(key, '/') - 1) as h, substr(key, strpos(key, '/')) as p from e),
m as (
  select u.*, s.key, s.action, s.rank,
         row_number() over (partition by u.n order by s.rank nulls last, length(s.key) desc, s.key desc) as best
  from u left join s on (u.host = s.h or ends_with(u.host, '.' || s.h)) and starts_with(u.path, s.p))
select page_id, host, path, case when rank = 0 then key end as rule, coalesce(action, 'allow') as verdict,
       case when rank = 1 then key end as listed
from m where best = 1
"""
