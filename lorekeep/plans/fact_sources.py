"""Sources of profile facts: an order stands for a memory, its lines for the memory's facts, with an attribution, profile and time each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fact_sources as sources
from .fixtures import table
from .recall import query

_TYPES = ["relationship_interaction", "affect", "preference", "plan", "commitment", "state", "event", ""]
_REASONS = ["relationship_significance", "affective_significance", "stable_personal_fact", "future_utility", "commitment_or_decision", "repeated_completed_action", "completed_action", "specific_grounded_observation", ""]
_of = lambda values, x: f"case {x} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"
#: Columns of a line in words that both engines know; l_partkey is p, l_suppkey is s.
_LINE = {
    "fact": "case when p % 11 = 0 then '  ' when p % 13 = 0 then ' password: ' || cast(p as string) when p % 17 = 0 then '482913 is the verification code' else ' likes ' || cast(p as string) || ' ' end",
    "subject": "case s % 8 when 0 then 'bot' when 1 then null else actor || ' ' end",
    "two": "s % 8 = 2",
    "claim": _of(["hearsay", "direct_observation", "speaker_requests_other", "speaker_self", "speaker_self"], "p % 5"),
    "state": "case p % 7 when 0 then 'uncertain' when 1 then null else 'verified' end",
    "kind": _of(_TYPES, "s % 8"), "lasting": "case when p % 2 = 0 then 'high' else 'low' end", "why": _of(_REASONS, "(p + 2 * s) % 9"),
    "shifted": "p % 6 = 0", "lost": "p % 19 = 0", "started": "case when p % 3 = 0 then q * 100 end",
}
_ORDER = {"actor": "'u' || cast(o_custkey % 50 as string)", "basis": "case when o_orderkey % 10 = 0 then 'timeline_summary_only' end", "bare": "o_orderkey % 20 = 0"}
_select = lambda d: ", ".join(f"{v} as {k}" for k, v in d.items())


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{v} as {k}" for k, v in _ORDER.items()])
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as o_orderkey", "struct(l_linenumber as n, l_partkey as p, l_suppkey as s, l_quantity as q, l_discount as d) as line").groupBy("o_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    cells = lambda expr: F.expr(f"transform(lines, (x, i) -> {expr})")
    said = {k: v.replace("p %", "x.p %").replace("s %", "x.s %").replace("cast(p ", "cast(x.p ").replace("(p + 2 * s)", "(x.p + 2 * x.s)").replace("q * 100", "x.q * 100") for k, v in _LINE.items()}
    attribution = f"if({said['lost']}, null, named_struct('fact_index', if({said['shifted']}, i + 1, null), 'subjects', if({said['two']}, array(actor, 'bot'), array_compact(array({said['subject']}))), 'claim_type', {said['claim']}, 'status', {said['state']}, 'confidence', x.d * 12))"
    return orders.join(lines, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("timeline_uid"), (F.col("o_orderkey") % 3).alias("revision"), F.col("actor").alias("actor_id"), (F.col("o_orderkey") * 60.0).alias("create_s"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") * 90.0).alias("updated_s"), F.lit(None).cast("double").alias("importance"), F.col("basis").alias("evidence_basis"),
        cells(said["fact"]).alias("facts"), F.when(~F.col("bare"), cells(attribution)).alias("attributions"),
        cells(f"named_struct('fact_index', int(null), 'fact_type', {said['kind']}, 'durability', {said['lasting']}, 'reason', {said['why']})").alias("profiles"),
        cells(f"named_struct('fact_index', int(null), 'start_s', {said['started']}, 'end_s', double(null))").alias("times"),
    )


def _signal_sql() -> str:
    whens = []
    for signal, types, durabilities, reasons in sources.SIGNALS:
        isin = lambda x, values: f"{x} in ({', '.join(repr(v) for v in values)})"
        further = " or ".join([isin("lasting", durabilities)] * bool(durabilities) + [isin("why", reasons)] * bool(reasons))
        whens.append(f"when {' and '.join([isin('kind', types)] * bool(types) + [f'({further})'] * bool(further))} then '{signal}'")
    return f"case {' '.join(whens)} else '{sources.REVIEW}' end"


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_SECRET = "regexp_matches(fact, '(?i)\\b(password|passwd)\\b') or regexp_matches(fact, '(?i)\\b\\d{6}\\b.*verification code')"


@query(f"""with o as (select o_orderkey, {_select(_ORDER)} from orders),
ln as (select o.*, l_partkey as p, l_suppkey as s, l_quantity as q, l_discount as d, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 as i from lineitem join o on l_orderkey = o_orderkey),
x as (select *, {_select(_LINE)} from ln), att as (select o_orderkey, case when shifted then i + 1 else i end as i, max_by(struct_pack(subject, two, claim, state, d), i) as a from x where not lost and not bare group by 1, 2),
nn as (select o_orderkey, count(*) as n_at from att group by 1),
y as (select x.* exclude (subject, two, claim, state, d), trim(fact) as raw_fact, a, a.subject as subject, a.two as two, coalesce(a.claim, '') as claim, coalesce(a.state, 'verified') as state, a.d as d, {_signal_sql()} as sig,
  basis is not null and n_at is null as summary_only, greatest(1, o_orderkey % 3) as revision, case when o_orderkey % 4 = 0 then o_orderkey * 90.0::double end as updated_s from x left join att using (o_orderkey, i) left join nn using (o_orderkey)),
z as (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(o_orderkey || chr(31) || revision || chr(31) || i || chr(31) || actor)) as h from y)
select {_UUID} as source_uid, o_orderkey::varchar as timeline_uid, revision, i as fact_index, raw_fact, actor as actor_id, case when summary_only then 'legacy_summary_candidate' else claim end as claim_type,
 round(case when summary_only then 0.45 else least(1, coalesce(d * 12, 0)) end, 6) as confidence, case when summary_only then '{sources.REVIEW}' else sig end as signal,
 case when summary_only then o_orderkey * 60.0::double else coalesce(nullif(started, 0), o_orderkey * 60.0::double) end as started_s, coalesce(nullif(updated_s, 0), o_orderkey * 60.0::double) as ended_s,
 coalesce(basis, 'message_grounded') as evidence_basis, case when raw_fact = '' then 'empty_fact' when summary_only then (case when {_SECRET} then 'secret' end) when a is null or two or subject is null or trim(subject) <> actor then 'other_subject'
 when claim not in {sources.OWN_CLAIMS} then 'claim_type' when state in {sources.OPEN_ATTRIBUTIONS} then 'open_attribution' when sig = 'relationship_only' then 'relationship_only' when {_SECRET} then 'secret' end as reason from z""")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of every memory, as a candidate or with the rule against it."""
    return sources.fact_sources(_memories(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6)).drop("importance")
