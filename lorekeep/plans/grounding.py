"""Grounding of memories: an order stands for a memory, its lines for facts with evidence and subjects, and up to four messages with what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding
from ..operators.tables import checkpointed
from .fixtures import table
from .recall import query

_CLAIM = "case {p} % 6 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(grounding.CLAIMS)) + " else 'rumour' end"
_SUBJECT = "case {s} % 5 when 0 then 'A' when 1 then (case when {p} % 7 = 0 then 'C' else 'B' end) when 2 then 'none' when 3 then 'unresolved' end"
_NAME = "case when {s} % 5 = 2 and {p} % 3 = 0 or {s} % 5 = 3 and {p} % 2 = 0 then 'who' end"
_OF = "case ({o} + {j}) % 4 when 0 then 'fact' when 1 then 'context' when 2 then 'omitted' else 'kept' end"
_CODE = "case ({o} + 2 * {j}) % 3 when 0 then 'durable_fact' when 1 then 'small_talk' else 'durable_interaction' end"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "struct(l_linenumber as n, l_partkey as p, l_suppkey as s, l_quantity as q, l_discount as d) as line"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as o", line).groupBy("o").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    at = {"p": "x.p", "s": "x.s", "o": "o", "j": "j"}
    cell = lambda t: t.format(**at)
    row = f"named_struct('message_ref', concat('m', j), 'disposition', {cell(_OF)}, 'reason_code', {cell(_CODE)}, 'reason', if((o + j) % 5 = 0, null, 'why'), 'fact_indexes', if((o + j) % 3 = 0, array(), array((o + j) % 8)))"
    return lines.selectExpr(
        "o as doc_id", "transform(lines, x -> concat('fact ', x.p)) as key_facts", "transform(sequence(1, o % 4 + 1), j -> concat('m', j)) as message_refs", "array('A', 'B') as actor_refs", "map('m1', 'A', 'm2', 'B') as speakers",
        "transform(lines, (x, i) -> named_struct('fact_index', if(x.p % 11 = 0, 'x', string(if(x.p % 13 = 0, i + 1, i))), 'message_refs', case x.p % 5 when 0 then array() when 1 then array('m9') else array('m1') end)) as evidence",
        f"transform(lines, (x, i) -> named_struct('fact_index', if(x.p % 17 = 0, null, string(if(x.p % 19 = 0, i + 1, i))), 'claim_type', {cell(_CLAIM)}, 'confidence', x.d * 12, 'subjects', if(x.s % 5 = 4, array(), array(named_struct('actor_ref', {cell(_SUBJECT)}, 'name', {cell(_NAME)}))))) as attributions",
        f"transform(concat(filter(sequence(1L, o % 4 + 1), j -> o % 9 > 0 or j > 1), if(o % 10 = 0, array(1L), array())), j -> {row}) as coverage",
    )


_plain = {"p": "p", "s": "s", "o": "doc_id", "j": "j"}
_PARTS = f"""with ln as (select l_orderkey as doc_id, l_partkey as p, l_suppkey as s, l_discount as d, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 as i from lineitem),
n as (select doc_id, count(*) as n from ln group by 1), r as (select *, case when p % 11 = 0 then null when p % 13 = 0 then i + 1 else i end as k, case when p % 17 = 0 then null when p % 19 = 0 then i + 1 else i end as k2 from ln),
ev as (select *, k is not null and row_number() over (partition by doc_id, k order by i) = 1 as one from r),
ar as (select *, k2 is not null and row_number() over (partition by doc_id, k2 order by i) = 1 as one, {_CLAIM.format(**_plain)} as claim, {_SUBJECT.format(**_plain)} as ref, {_NAME.format(**_plain)} as name from r),
au as (select ar.*, ref is not null as told, coalesce(ref = 'A' and e.p % 5 > 1, false) as own from ar left join (select doc_id, k, p from ev where one) e on e.doc_id = ar.doc_id and e.k = ar.k2),
me as (select doc_id, unnest(range(1, doc_id % 4 + 2)) as j from n), co as (select *, {_OF.format(**_plain)} as disp, {_CODE.format(**_plain)} like 'durable%' as lasting, (doc_id + j) % 3 > 0 as used, (doc_id + j) % 8 as f, n from me join n using (doc_id) where doc_id % 9 > 0 or j > 1 or doc_id % 10 = 0),
ei as (select doc_id, count(*) filter (k is null) as invalid_fact_evidence_index, count(*) filter (k is not null and not one) as duplicate_fact_evidence, count(*) filter (one and p % 5 = 0) as missing_fact_evidence, count(*) filter (one and p % 5 = 1) as unknown_fact_evidence,
  case when count(*) filter (one and k < n) < any_value(n) or max(k) >= any_value(n) then 1 else 0 end as incomplete_fact_evidence from ev join n using (doc_id) group by 1),
ai as (select doc_id, count(*) filter (k2 is null) as invalid_fact_attribution_index, count(*) filter (k2 is not null and not one) as duplicate_fact_attribution, case when count(*) filter (one and k2 < n) < any_value(n) or max(k2) >= any_value(n) then 1 else 0 end as incomplete_fact_attributions,
  count(*) filter (one and claim = 'rumour') as invalid_fact_claim_type, count(*) filter (one and d * 12 > 1) as invalid_fact_attribution_confidence, count(*) filter (one and not told) as missing_fact_subject, count(*) filter (one and ref = 'unresolved' and name is null) as unresolved_fact_subject_without_name,
  count(*) filter (one and ref = 'none' and name is not null) as non_actor_subject_has_name, count(*) filter (one and ref = 'C') as unknown_fact_subject, count(*) filter (one and told and claim = 'speaker_self' and not own) as speaker_self_subject_mismatch,
  count(*) filter (one and told and claim = 'speaker_reports_other' and own) as other_claim_subject_is_speaker, count(*) filter (one and told and claim = 'speaker_requests_other' and not own) as speaker_request_subject_mismatch, count(*) filter (one and told and claim = 'uncertain') as uncertain_fact_attribution from au join n using (doc_id) group by 1),
ci as (select doc_id, case when doc_id % 10 = 0 and doc_id % 9 > 0 then 1 else 0 end as duplicate_message_coverage, count(*) filter (disp = 'kept') as invalid_message_disposition, count(*) filter (used and f >= n) as unknown_coverage_fact, count(*) filter (disp = 'fact' and not used) as ungrounded_fact_disposition,
  count(*) filter (disp = 'fact' and not lasting) as fact_without_durable_reason, count(*) filter (disp <> 'fact' and lasting) as durable_reason_without_fact, count(*) filter (disp = 'omitted' and (doc_id + j) % 5 = 0) as missing_omission_reason from co group by 1),
cm as (select doc_id, case when doc_id % 9 = 0 and doc_id % 10 > 0 then 1 else 0 end as incomplete_message_coverage from n),
al as (select doc_id, code, 'key_fact_evidence' as field, v::bigint as n from (unpivot ei on columns(* exclude (doc_id)) into name code value v) union all select doc_id, code, 'key_fact_attributions', v from (unpivot ai on columns(* exclude (doc_id)) into name code value v)
  union all select doc_id, code, 'message_coverage', v from (unpivot ci on columns(* exclude (doc_id)) into name code value v) union all select doc_id, 'incomplete_message_coverage', 'message_coverage', incomplete_message_coverage from cm),
iss as (select doc_id, code, field, case when code = 'uncertain_fact_attribution' then 'warning' else 'error' end as severity, n from al where n > 0)"""


@query(_PARTS + " select * from iss")
def grounding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every memory, with how often."""
    return grounding.grounding_issues(_records(spark, sf_dir))


@query(_PARTS + """, w as (select doc_id, bool_or(severity = 'error') as bad from iss group by 1), g as (select doc_id, count(*) filter (one and p % 5 > 1) as n_grounded from ev group by 1), k as (select doc_id, count(distinct j) as n_covered from co group by 1)
select doc_id, case when bad then 'repairable' when bad is not null then 'warning' else 'normal' end as status, doc_id % 4 + 1 as n_messages, n_grounded, coalesce(n_covered, 0) as n_covered from n left join w using (doc_id) left join g using (doc_id) left join k using (doc_id)""")
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, grounded facts and covered messages of every memory."""
    records = _records(spark, sf_dir)
    out = grounding.grounding_report(records, checkpointed(grounding.grounding_issues(records)))
    return out.withColumns({x: F.col(x).cast("long") for x in ("n_messages", "n_grounded", "n_covered")})
