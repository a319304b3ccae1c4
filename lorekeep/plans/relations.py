"""Weighted word overlap, related topics and what they are chosen from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import relations, topics
from .fixtures import table, view
from .recall import cosine_sql, query

#: The given vectors are near right angles to one another; a constant part brings their cosines to where the rules' bounds lie.
CONSTANT = 1.3
LIMIT, FLOOR = 12, 0.60


def structural_sql(x: str) -> str:
    return f"regexp_matches(trim(lower({x})), '{relations.STRUCTURAL}')"


def terms_sql(x: str) -> str:
    """Latin words only: the given tables hold no Chinese text."""
    found = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+'))"
    return f"list_filter({found}, lambda w: length(w) > 1 and not {structural_sql('w')})"


DOC_TERMS = f"""with t as (select coalesce(lang, '') as space, doc_id as uid, unnest({terms_sql('text')}) as term from documents),
sz as (select space, count(distinct uid) as n from t group by 1), df as (select space, term, count(*) as df from t group by 1, 2),
w as (select t.*, round(1 + ln((n + 1.0) / (df + 1.0)), 9) as w from t join df using (space, term) join sz using (space)),
tot as (select space, uid, sum(w) as total from w group by 1, 2),
cl as (select space, min(uid) as uid from (select space, uid, list_sort(list(term)) as s from t group by 1, 2) group by space, s),
r as (select w.* from w join cl using (space, uid))"""


@query(DOC_TERMS + """, p as (select x.space, x.uid as a, y.uid as b, sum(x.w) as shared from r x join r y on x.space = y.space and x.term = y.term and x.uid < y.uid group by all),
j as (select p.space, a, b, shared / (ta.total + tb.total - shared) as s from p join tot ta on p.space = ta.space and a = ta.uid join tot tb on p.space = tb.space and b = tb.uid)
select space, a, b, round(s, 6) as similarity from j where round(s, 9) >= 0.6""")
def weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one language by rarity-weighted overlap of their words."""
    d = table(spark, sf_dir, "documents")
    terms = d.select(F.coalesce("lang", F.lit("")).alias("space"), F.col("doc_id").alias("uid"), F.explode(relations.text_terms(F.col("text"))).alias("term"))
    return relations.weighted_jaccard_join(terms, 0.6).select("space", "a", "b", F.round("similarity", 6).alias("similarity"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Items, rankings, keywords, text terms and sources of the topics; a topic's texts are those of the document with its number."""
    items = view(spark, sf_dir, "fx_topics").select(F.col("memory_space_id").alias("space"), F.col("topic_id").alias("uid"), F.concat("embedding", F.array(F.lit(CONSTANT).cast("float"))).alias("embedding"))
    ranked = topics.margins(topics.vector_neighbours(items, FLOOR, LIMIT), FLOOR)
    texts = items.select("space", "uid").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text"), "uid")
    longer = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 9)
    keywords = texts.select("space", "uid", F.explode(relations.keyword_terms(F.concat(F.array_distinct(longer), F.array(F.concat(F.lit("group "), F.col("uid") % 41), F.lit("2024"), F.lit("5月3日"), F.lit("计划"))))).alias("term"))
    words = texts.select("space", "uid", F.explode(relations.text_terms(F.col("text"))).alias("term"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("uid"), (F.col("l_orderkey") % 900).alias("source")).distinct()
    return items, ranked, keywords, words, items.select("space", "uid").join(links, "uid")


_E = f"list_append(embedding::double[], {CONSTANT}::float::double)"
RELATED = f"""with it as (select memory_space_id as space, topic_id as uid, {_E} as e from (select vec_id as topic_id, embedding, 'space' || cast(vec_id % 3 as varchar) as memory_space_id from embeddings)),
pr as (select a.space, a.uid as a, b.uid as b, round({cosine_sql('a.e', 'b.e')}, 9) as cosine from it a join it b on a.space = b.space and a.uid < b.uid),
pf as (select * from pr where cosine >= {FLOOR}), bo as (select space, a as uid, b as other, cosine from pf union all select space, b, a, cosine from pf),
rk as (select *, row_number() over (partition by space, uid order by cosine desc, other) as rank from bo qualify rank <= {LIMIT}),
rm as (select *, greatest(0, cosine - coalesce(lead(cosine) over (partition by space, uid order by cosine desc, other), {FLOOR})) as margin from rk),
pp as (select space, least(uid, other) as a, greatest(uid, other) as b, max(cosine) as similarity, coalesce(max(case when uid < other then rank end), 1000000000) as rank_a, coalesce(max(case when uid > other then rank end), 1000000000) as rank_b,
  coalesce(max(case when uid < other then margin end), 0) as margin_a, coalesce(max(case when uid > other then margin end), 0) as margin_b from rm group by all),
tx as (select space, uid, text from it join documents on doc_id = uid), sz as (select space, count(distinct uid) as n from it group by 1),
kw0 as (select space, uid, list_concat(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 9), ['group ' || (uid % 41), '2024', '5月3日', '计划']) as k from tx where text is not null),
kw as (select distinct space, uid, term from (select space, uid, unnest(list_concat(list_transform(k, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')), flatten(list_transform(k, lambda x: regexp_extract_all(lower(x), '[a-z0-9_-]{{2,}}'))))) as term from kw0) where not {structural_sql('term')}),
kd as (select space, term, count(*) as df from kw group by 1, 2),
kr as (select kw.*, round(ln((n + 1.0) / (df + 1.0)) / ln(n + 1.0), 9) as rarity from kw join kd using (space, term) join sz using (space) where df <= greatest(2, ceil(n * 0.15)) and term <> '计划'),
sh as (select pp.space, a, b, list(x.term) as terms, list(x.rarity) as rarities from pp join kr x on pp.space = x.space and a = x.uid join kr y on pp.space = y.space and b = y.uid and x.term = y.term group by 1, 2, 3),
ke as (select space, a, b, list_filter(list_zip(terms, rarities), lambda z: len(list_filter(terms, lambda y: y <> z[1] and contains(y, z[1]))) = 0) as kept from sh),
tt as (select space, uid, unnest({terms_sql('text')}) as term from tx), td as (select space, term, count(*) as df from tt group by 1, 2),
tw as (select tt.*, round(1 + ln((n + 1.0) / (df + 1.0)), 9) as w from tt join td using (space, term) join sz using (space)), tot as (select space, uid, sum(w) as total from tw group by 1, 2),
lx as (select pp.space, a, b, sum(x.w) as shared from pp join tw x on pp.space = x.space and a = x.uid join tw y on pp.space = y.space and b = y.uid and x.term = y.term group by 1, 2, 3),
so as (select it.space, uid, list(distinct l_orderkey % 900) as s from it join lineitem on l_partkey = uid group by 1, 2),
f as (select pp.*, n, coalesce(kept, []) as kept, round(coalesce(shared / (ta.total + tb.total - shared), 0), 9) as lexical, coalesce(len(list_intersect(sa.s, sb.s)), 0) as n_sources,
  coalesce(len(list_intersect(sa.s, sb.s)), 0)::double / greatest(1, len(list_distinct(list_concat(coalesce(sa.s, []), coalesce(sb.s, []))))) as source_overlap
  from pp join sz using (space) left join ke using (space, a, b) left join lx using (space, a, b) left join tot ta on pp.space = ta.space and pp.a = ta.uid left join tot tb on pp.space = tb.space and pp.b = tb.uid
  left join so sa on pp.space = sa.space and pp.a = sa.uid left join so sb on pp.space = sb.space and pp.b = sb.uid),
g as (select *, len(kept) as n_keywords, len(list_filter(kept, lambda z: regexp_matches(z[1], '^[a-z0-9_-]{{2,}}$') and regexp_matches(z[1], '[a-z]'))) > 0 as ident, coalesce(list_max(list_transform(kept, lambda z: z[2])), 0) as strong,
  greatest(rank_a, rank_b) <= 3 as core, greatest(rank_a, rank_b) <= 12 as around, rank_a = 1 and rank_b = 1 as firsts from f),
h as (select *, case when n_keywords >= 2 and similarity >= 0.62 then 'multiple_discriminative_keywords' when ident and similarity >= 0.6 then 'shared_distinctive_identifier'
  when strong >= 0.4 and similarity >= (case when strong >= 0.7 or (strong >= 0.65 and around) then 0.62 else 0.68 end) then 'single_discriminative_keyword' when lexical >= 0.08 and similarity >= 0.68 then 'weighted_lexical_overlap'
  when n_sources > 0 and similarity >= 0.74 and (n_keywords > 0 or lexical >= 0.025 or (source_overlap >= 0.5 and similarity >= 0.78)) then 'shared_timeline_with_semantic_support'
  when core and similarity >= 0.81 then 'strong_reciprocal_semantics' when n >= 8 and around and similarity >= 0.78 then 'strong_neighborhood_semantics'
  when n >= 4 and firsts and (similarity >= 0.78 or (similarity >= 0.72 and least(margin_a, margin_b) >= 0.025)) then 'distinctive_mutual_semantics' end as evidence_kind from g)
select space, a, b, round(similarity, 6) as similarity, evidence_kind, round(similarity + (case when core then 0.035 else 0 end) + (case when around then 0.015 else 0 end) + (case evidence_kind {' '.join(f"when '{k}' then {v}" for k, v in relations.EVIDENCE_BONUS.items())} end)
  + least(0.01, source_overlap * 0.01), 6) as score, n_keywords, round(lexical, 6) as lexical, round(source_overlap, 6) as source_overlap from h where evidence_kind is not null"""


@query(RELATED)
def topic_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring topics with evidence that they are related, and its kind."""
    out = relations.related_topics(*_ordered(_parts(spark, sf_dir)))
    return out.select("space", "a", "b", F.round("similarity", 6).alias("similarity"), "evidence_kind", F.round("score", 6).alias("score"), "n_keywords", F.round("lexical", 6).alias("lexical"), F.round("source_overlap", 6).alias("source_overlap"))


def _ordered(parts: tuple[DataFrame, ...]) -> tuple[DataFrame, ...]:
    items, ranked, keywords, words, sources = parts
    return ranked, items, keywords, words, sources


@query()
def bounded_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the related topics, at most three edges a topic."""
    return topics.bounded_edges(relations.related_topics(*_ordered(_parts(spark, sf_dir))).select("a", "b", "score"), 3)
