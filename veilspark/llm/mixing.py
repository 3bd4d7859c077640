"""Mixing sources to target weights, in built-in expressions only.

Documents hang on a tree domain - language - source.  A token budget is handed
down the tree by weights.  A node can take at most its supply times
MAX_EPOCHS; what it cannot take goes to its siblings first (water-filling
within the parent), and only what a whole parent cannot take goes to the
parent's siblings: a parent's capacity is the sum of its children's, and the
filling runs from the root down.  Budgets are whole tokens, rounded down.

A leaf of budget b and supply s takes all its documents in b div s epochs,
and the prefix of b mod s tokens of one more.  Each epoch has an order of its
own, by MD5 of seed, epoch and doc_id; the document at the boundary is cut to
the tokens that are left.  Only hash buckets are summed; a window orders
nothing but the bucket in which a leaf's boundary falls.

Defined results: null lang or source is a node of its own named ''; null and
empty texts have no tokens and follow their place in the order; rows of equal
doc_id share a place, and if the boundary falls on them each gets an equal
share, rounded down.  An empty table gives an empty result.  Columns of the
documents other than those read are carried along; names that start with
``_mix`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_SQL, WORD_SQL, cut, table

SEED = "mix-1"
MAX_EPOCHS = 2
#: Budget as hundredths of the supply.
BUDGET_PERCENT = 80
#: Whole-number weights of siblings; DEFAULT for those not named.
DOMAINS = {"web": 50, "curated": 50}
LANGS = {"en": 50, "de": 20, "fr": 20, "es": 10}
DEFAULT = 10
#: Sources of the domain "web"; all others are "curated".
WEB = ["src0"]


def weight_of(col: Column, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT)
    for name, w in weights.items():
        out = F.when(col == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def key_of(seed: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def leaf_columns(df: DataFrame) -> DataFrame:
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return df.withColumns({"_mix_domain": F.when(source.isin(WEB), F.lit("web")).otherwise(F.lit("curated")), "_mix_lang": lang, "_mix_source": source})


def fill(nodes: DataFrame, parent: list[str], weight: str, cap: str, budget: str, out: str) -> DataFrame:
    """Adds column out: each sibling's share of the parent's budget, none above its cap.

    With siblings in order of cap / weight, those before the first that can
    take its share get their caps; the rest share what is left by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col(cap) / F.col(weight), *[c for c in ("_mix_domain", "_mix_lang", "_mix_source") if c in nodes.columns])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_mix_left": F.greatest(F.lit(0), F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))), "_mix_w": F.sum(weight).over(after)})
    fits = F.col("_mix_left") * F.col(weight) <= F.col(cap) * F.col("_mix_w")
    first = F.min(F.when(fits, F.struct(F.col(cap) / F.col(weight), F.col("_mix_left").alias("l"), F.col("_mix_w").alias("w")))).over(Window.partitionBy(*parent))
    nodes = nodes.withColumn("_mix_first", first)
    share = F.expr(f"_mix_first.l * {weight} div _mix_first.w")
    return nodes.withColumn(out, F.when(F.col("_mix_first").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), share))).drop("_mix_left", "_mix_w", "_mix_first")


def budgets(leaves: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves(_mix_domain, _mix_lang, _mix_source, supply) with their budgets in whole tokens."""
    d, l, s = "_mix_domain", "_mix_lang", "_mix_source"
    leaves = leaves.withColumns({"cap": F.col("supply") * epochs, "ws": F.lit(1).cast("long")})
    langs = leaves.groupBy(d, l).agg(F.sum("cap").alias("cap_l")).withColumn("wl", weight_of(F.col(l), LANGS))
    domains = langs.groupBy(d).agg(F.sum("cap_l").alias("cap_d")).withColumn("wd", weight_of(F.col(d), DOMAINS))
    # a row for each domain, of which there are as many as DOMAINS names
    domains = domains.withColumn("b", F.expr(f"sum(cap_d) over () div {epochs} * {percent} div 100"))
    domains = fill(domains, [], "wd", "cap_d", "b", "bd").select(d, "bd")
    langs = fill(langs.join(domains, d), [d], "wl", "cap_l", "bd", "bl").select(d, l, "bl")
    return fill(leaves.join(langs, [d, l]), [d, l], "ws", "cap", "bl", "budget").select(d, l, s, "supply", "budget")


def mix(docs: DataFrame, seed: str = SEED, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents taken, once for each epoch, with _mix_epoch and _mix_taken (tokens); the text at a boundary is cut."""
    leaf = ["_mix_domain", "_mix_lang", "_mix_source"]
    slim = cut(leaf_columns(docs.select("doc_id", "lang", "source", tokens_of(F.col("text")).alias("n"))).drop("lang", "source"), "mix-slim")
    plan = cut(budgets(slim.groupBy(*leaf).agg(F.sum("n").alias("supply")), percent, epochs).withColumns({"full": F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)), "rest": F.when(F.col("supply") > 0, F.expr("budget % supply")).otherwise(F.lit(0))}), "mix-plan")
    keyed = slim.join(plan, leaf).where("rest > 0").select(*leaf, "n", "rest", key_of(seed, F.col("full")).alias("key")).withColumn("bucket", F.substring("key", 1, 4))
    sums = keyed.groupBy(*leaf, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).where("before < rest and before + n >= rest")
    edge = keyed.join(sums.select(*leaf, "bucket", "before"), [*leaf, "bucket"]).groupBy(*leaf, "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    inner = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).where("before < rest and before + n >= rest")
    edge = edge.select(*leaf, F.col("key").alias("_mix_edge"), F.expr("if(before + n = rest, null, (rest - before) div rows)").alias("_mix_cut"))
    plan = cut(plan.join(edge, leaf, "left").select(*leaf, F.col("full").alias("_mix_full"), "_mix_edge", "_mix_cut"), "mix-edges")
    out = leaf_columns(docs).join(plan, leaf)
    key = key_of(seed, F.col("_mix_full"))
    # below the edge: whole; at the edge: cut, if its tokens pass the budget
    out = out.withColumn("_mix_key", key).withColumn("_mix_last", F.expr("case when _mix_key < _mix_edge or (_mix_key = _mix_edge and _mix_cut is null) then -1L when _mix_key = _mix_edge then _mix_cut else 0L end"))
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_mix_full").cast("int")), F.when(F.col("_mix_last") != 0, F.array("_mix_last")).otherwise(F.array().cast("array<bigint>")))
    out = out.select(*docs.columns, F.posexplode(times).alias("_mix_epoch", "_mix_take"))
    words = F.regexp_extract_all("text", F.lit(rf"{SPACE_SQL[:-1]}*{WORD_SQL}"), F.lit(0))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col("_mix_take").cast("int")), "")
    n = tokens_of(F.col("text"))
    out = out.withColumn("_mix_taken", F.when(F.col("_mix_take") < 0, n).otherwise(F.least(n, F.col("_mix_take"))))
    return out.withColumn("text", F.when((F.col("_mix_take") >= 0) & (n > F.col("_mix_take")), cut_text).otherwise(F.col("text"))).drop("_mix_take")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lang", "source", F.col("_mix_epoch").cast("int").alias("epoch"), F.col("_mix_taken").alias("tokens"), F.md5("text").alias("text_md5"))


ORACLE = r"""
with recursive t as (
  select doc_id, coalesce(lang, '') as l, coalesce(source, '') as s, case when coalesce(source, '') = 'src0' then 'web' else 'curated' end as d,
         lang, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n from documents),
leaf as (select d, l, s, sum(n)::bigint as supply, sum(n)::bigint * 2 as cap from t group by all),
lang0 as (select d, l, sum(cap)::bigint as cap, case l when 'en' then 50 when 'de' then 20 when 'fr' then 20 when 'es' then 10 else 10 end as w from leaf group by d, l),
dom0 as (select d, sum(cap)::bigint as cap, 50 as w, (sum(sum(cap)) over () // 2 * 80 // 100)::bigint as b from lang0 group by d),
dom1 as (select *, greatest(0, b - coalesce(sum(cap) over (order by cap / w, d rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
                sum(w) over (order by cap / w, d rows between current row and unbounded following)::bigint as ww from dom0),
dom2 as (select d, cap, w, (select struct_pack(lft := x.lft, ww := x.ww) from dom1 x where x.lft * x.w <= x.cap * x.ww order by x.cap / x.w, x.d limit 1) as f from dom1),
dom as (select d, (case when f is null then cap else least(cap, f.lft * w // f.ww) end)::bigint as b from dom2),
lang1 as (select a.*, dom.b, greatest(0, dom.b - coalesce(sum(a.cap) over (partition by a.d order by a.cap / a.w, l rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
                 sum(a.w) over (partition by a.d order by a.cap / a.w, l rows between current row and unbounded following)::bigint as ww from lang0 a join dom using (d)),
lang2 as (select *, first_value(case when lft * w <= cap * ww then struct_pack(lft := lft, ww := ww) end ignore nulls) over (partition by d order by cap / w, l rows between unbounded preceding and unbounded following) as f from lang1),
lng as (select d, l, (case when f is null then cap else least(cap, f.lft * w // f.ww) end)::bigint as b from lang2),
leaf1 as (select a.*, lng.b, greatest(0, lng.b - coalesce(sum(cap) over (partition by a.d, a.l order by cap, s rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
                 count(*) over (partition by a.d, a.l order by cap, s rows between current row and unbounded following) as ww from leaf a join lng using (d, l)),
leaf2 as (select *, first_value(case when lft <= cap * ww then struct_pack(lft := lft, ww := ww) end ignore nulls) over (partition by d, l order by cap, s rows between unbounded preceding and unbounded following) as f from leaf1),
plan as (select d, l, s, supply, (case when f is null then cap else least(cap, f.lft // f.ww) end)::bigint as b from leaf2),
p as (select *, case when supply > 0 then b // supply else 0 end as full_, case when supply > 0 then b % supply else 0 end as rest from plan),
k as (select t.*, p.full_, p.rest, md5('mix-1|' || p.full_ || '|' || coalesce(cast(doc_id as varchar), 'null')) as key from t join p using (d, l, s)),
o as (select *, coalesce(sum(n) over (partition by d, l, s order by key rows between unbounded preceding and 1 preceding), 0)::bigint as before_ from k),
r as (select doc_id, lang, source, text, n, full_ as epoch, case when before_ + n <= rest then n else rest - before_ end as take from o where before_ < rest
      union all select doc_id, lang, source, text, n, unnest(range(0, full_)) as epoch, n as take from k where full_ > 0)
select doc_id, lang, source, cast(epoch as int) as epoch, cast(take as bigint) as tokens,
       md5(case when take < n then array_to_string(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+')[1:take], '') else text end) as text_md5
from r
"""
