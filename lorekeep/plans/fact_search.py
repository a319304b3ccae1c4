"""Search in facts, with queries of both kinds: whole texts, and pieces from inside words that no keyword finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import fact_search as search
from .fixtures import table, view
from .recall import query, tokens_sql
from .topics_life import ATOMS, _atoms

K = 5
_DECAY = "case when kind = 'relational' then greatest(0, 1 - days / ttl) when kind = 'planned' then (case when days <= ttl then 1 else 0.05 end) else exp(-ln(2.0) * days / greatest(0.5, ttl / 2)) end"


@query(ATOMS + f""", q as (select query_id, query_text as text from (select item_id as query_id, text as query_text from benchmark) union all
  select 1000000 + doc_id, substr(regexp_extract(text, '[A-Za-z]{{6,}}'), 2, 4) || ' ' || substr(regexp_extract(text, '[A-Za-z]{{8,}}'), 4, 4) from documents where doc_id % 50 = 0 and text is not null),
fa as (select doc_id, text, {tokens_sql('text')} as tokens, {_DECAY} as temporal from t where status = 'active'),
n as (select count(*) as n_docs, avg(len(tokens)) as avg_length from fa),
p as (select doc_id, length, term, count(*) as tf from (select doc_id, len(tokens) as length, unnest(tokens) as term from fa) group by all), df as (select term, count(*) as df from p group by 1),
qt as (select query_id, unnest(list_distinct({tokens_sql('text')})) as term from q),
s as (select query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) as score from qt join p using (term) join df using (term) cross join n group by 1, 2),
k as (select * from s qualify row_number() over (partition by query_id order by score desc, doc_id) <= {2 * K}),
kb as (select query_id, doc_id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1 end as base, 'keywords' as found_by from k window w as (partition by query_id)),
qp as (select query_id, unnest(string_split(lower(text), ' ')) as part from q where query_id not in (select query_id from k)),
cf as (select distinct query_id, doc_id from qp join fa on length(part) > 0 and contains(lower(text), part)),
cn as (select query_id, doc_id, 1.0::double as base, 'containment' as found_by from cf qualify row_number() over (partition by query_id order by doc_id desc) <= {2 * K}),
b as (select x.*, round(base * temporal, 9) as score from (select * from kb union all select * from cn) x join fa using (doc_id))
select query_id, doc_id, round(base, 6) as base, round(score, 6) as score, found_by, row_number() over (partition by query_id order by score desc, doc_id) as rank from b qualify rank <= {K}""")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by keywords and decay, or by containment where keywords find none."""
    atoms = _atoms(spark, sf_dir).where("status = 'active'")
    facts = atoms.select("doc_id", F.col("text").alias("content"), c.tokenize(F.col("text")).alias("tokens"), c.decay_score(c.ttl_decay(F.col("kind")), F.col("ttl"), F.col("days")).alias("temporal"))
    inner = table(spark, sf_dir, "documents").where("doc_id % 50 = 0 and text is not null").select((F.col("doc_id") + 1000000).alias("query_id"), F.concat(F.substring(F.regexp_extract("text", "[A-Za-z]{6,}", 0), 2, 4), F.lit(" "), F.substring(F.regexp_extract("text", "[A-Za-z]{8,}", 0), 4, 4)).alias("text"))
    q = view(spark, sf_dir, "fx_queries").select("query_id", F.col("query_text").alias("text")).unionByName(inner)
    asked = q.select("query_id", c.tokenize(F.col("text")).alias("tokens"), F.split("text", " ").alias("parts"))
    return search.fact_search(facts, asked, K).withColumns({x: F.round(x, 6) for x in ("base", "score")})
