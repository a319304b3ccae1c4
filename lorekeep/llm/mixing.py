"""Operator 2: mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh WEIGHTS in turn and share `share` times all words; a target stops at
`cap` times its source's words and the excess is reshared by weight until none is above. That fixed point is found in closed
form over the table of sources (one row each), by sorting them by words per weight.

Sampling: a source with target T and S words gives each of its documents T / S expected copies: the whole copies are certain,
the rest is an inclusion probability p. Documents are ranked by Pareto's q = (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id
and the seed, and the extra copies go to the first ones, as many as bring the source's words nearest to its target. The cut is
found from sums per source and rank bin (BINS a source), and again inside the bin that it falls in, so only one in some sixteen
million documents of a source is ever ordered together with others.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source, last in order; rows that repeat a
doc_id are ranked side by side (ties by size, then text hash); an empty table gives an empty mix; other columns are ignored.
The same rows give the same mix, whatever their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, documents, written

#: The weights that sources take in turn.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BINS = 4096
SEED = "mix-1"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5; 0.5 for a null."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), doc_id.cast("string"))), 1, 13), 16, 10).cast("double")
    return F.coalesce((bits + 0.5) / F.lit(float(1 << 52)), F.lit(0.5))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): one row per source, so the ordered passes below run over sources only."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    by_need = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    out = sources.withColumn("__weight", weight).withColumn("__most", F.lit(cap) * F.col("source_size")).withColumn("__ratio", F.col("__most") / F.col("__weight"))
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    full = F.coalesce(F.sum("__most").over(before), F.lit(0.0))
    rest = F.sum("__weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("__level", (budget - full) / rest)
    # sources before the first whose level is not above its ratio are full; that level holds for all others
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", F.col("source").isNull(), "source", "__level"))).over(everything)["__level"]
    return out.select("source", "source_size", F.when(level.isNull(), F.col("__most")).otherwise(F.least("__most", level * F.col("__weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = written(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("__tie")), "mix-sizes")
    # one row a source, written once, so that the plans below only read it
    goals = targets(sized, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("__whole", F.floor(rate)).withColumn("__p", rate - F.floor(rate)).withColumn("__left", F.col("target") - F.col("__whole") * F.col("source_size"))
    goals = written(goals.select(F.struct("source").alias("__src"), "source_size", "target", "__whole", "__p", "__left"), "mix-goals")
    ranked = _ranked(sized.select(F.struct("source").alias("__src"), "doc_id", "size", "__tie").join(goals, "__src"), seed)
    edges = written(_edge(ranked, "__bin", "__left").select("__src", F.col("bin").alias("__edge"), F.col("open").alias("__open")), "mix-edges")
    inner = ranked.join(edges, "__src").where(F.col("__bin") == F.col("__edge"))
    fine = written(_edge(inner, "__fine", "__open").select("__src", F.col("bin").alias("__fine_edge"), F.col("open").alias("__rest")), "mix-fine-edges")
    rows = ranked.join(edges.join(fine, "__src"), "__src", "left")
    inside = (F.col("__bin") == F.col("__edge")) & (F.col("__fine") == F.col("__fine_edge"))
    whole, at_edge = rows.where(~F.coalesce(inside, F.lit(False))), rows.where(inside)
    before = (F.col("__bin") < F.coalesce("__edge", F.lit(BINS))) | ((F.col("__bin") == F.col("__edge")) & (F.col("__fine") < F.col("__fine_edge")))
    whole = whole.withColumn("__extra", F.when(before, 1).otherwise(0))
    order = Window.partitionBy("__src").orderBy("__q", "doc_id", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sum("size").over(order) - F.col("size")
    at_edge = at_edge.withColumn("__extra", F.when(gone + F.col("size") / 2 <= F.col("__rest"), 1).otherwise(0))
    # a prefix of the order: nothing is taken after the first document that is not
    at_edge = at_edge.withColumn("__extra", F.min("__extra").over(order))
    out = whole.unionByName(at_edge).withColumn("copies", (F.col("__whole") + F.col("__extra")).cast("long"))
    return out.select("doc_id", "size", F.col("__src")["source"].alias("source"), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _ranked(rows: DataFrame, seed: str) -> DataFrame:
    """rows with Pareto's rank q, its bin, and its bin inside that bin; null where nothing but whole copies is taken."""
    u = uniform(F.col("doc_id"), seed)
    rows = rows.withColumn("__q", F.when(F.col("__p") > 0, (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))))
    at = F.col("__q") / (1 + F.col("__q")) * BINS
    rows = rows.withColumn("__bin", F.least(F.floor(at), F.lit(BINS - 1)).cast("int"))
    return rows.withColumn("__fine", F.least(F.floor((at - F.col("__bin")) * BINS), F.lit(BINS - 1)).cast("int"))


def _edge(rows: DataFrame, by: str, left: str) -> DataFrame:
    """(__src, bin, open): the bin in which a source's words reach what is left of its target, and what is left when it begins."""
    bins = rows.where(F.col(by).isNotNull()).groupBy("__src", by).agg(F.sum("size").alias("in_bin"), F.max(left).alias("left"))
    bins = bins.withColumn("upto", F.sum("in_bin").over(Window.partitionBy("__src").orderBy(by)))
    first = F.min_by(F.struct(F.col(by).alias("bin"), (F.col("left") - (F.col("upto") - F.col("in_bin"))).alias("open")), by)
    return bins.where(F.col("upto") >= F.col("left")).groupBy("__src").agg(first.alias("edge")).select("__src", "edge.bin", "edge.open")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP2_SQL = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  (cast('0x' || substr(md5('mix-1|' || doc_id), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u from documents),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from d group by source),
fill(round, source, source_size, weight, target, fixed) as (
  select 0, source, source_size, weight, 1.5::double * sum(source_size) over () * weight / sum(weight) over (), false from s
  union all
  select round + 1, source, source_size, weight,
    case when fixed or target > 2 * source_size then 2.0::double * source_size
         else (1.5::double * sum(source_size) over () - sum(case when fixed or target > 2 * source_size then 2 * source_size else 0 end) over ())
              * weight / sum(case when fixed or target > 2 * source_size then 0 else weight end) over () end,
    fixed or target > 2 * source_size
  from fill where round < 40),
t as (select source, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from fill where round = 40),
r as (select d.doc_id, d.size, t.source_size, t.target, floor(rate) as whole, rate - floor(rate) as p, target - floor(rate) * source_size as open, u, d.source
      from d join t on d.source is not distinct from t.source),
o as (select *, sum(size) over (partition by source order by u, doc_id rows unbounded preceding) - size as gone from r),
x as (select *, min(case when p > 0 and gone + size / 2.0 <= open then 1 else 0 end) over (partition by source order by u, doc_id rows unbounded preceding) as extra from o)
select doc_id, size, source_size, round(target, 6) as target, cast((whole + extra) * size as bigint) as taken from x
"""
