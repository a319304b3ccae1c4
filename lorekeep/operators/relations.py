"""Related topics: which neighbours share evidence, by rare keywords, weighted words, sources and ranks.

Terms are cleaned first (dates, times, numbers and words without a subject of their own say nothing about relation), then weighed by rarity in
their space. Sets are carried as arrays of codes, a weight of fixed width before the term, so that one hashed intersection of two arrays
gives both what a pair shares and what it weighs; no term of a pair becomes a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import set_blocks
from .tables import checkpointed

#: Words that are no evidence of a relation (persons, discourse, abstract connectors).
GENERIC_TERMS = [
    "我", "你", "他", "她", "它", "我们", "你们", "他们", "她们", "我的", "你的", "他的", "她的", "对方", "用户", "助手", "机器人", "名字", "身份", "确认", "相关", "有关", "内容",
    "事情", "情况", "问题", "状态", "安排", "计划", "记录", "日常", "近期", "近况", "交流", "互动", "持续", "需要", "需求", "方面", "现场", "边界", "项目",
]

_YEAR, _MONTH, _DAY = r"(?:19|20|21)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_TWO_MONTH, _TWO_DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Standalone forms of dates, times and small numbers; names that hold digits are none of these.
STRUCTURAL_FORMS = [
    "[年月日号时分秒]?",
    r"\d{1,2}",
    _YEAR,
    r"\d{1,2}[:：]\d\d(?::\d\d)?",
    r"\d{1,2}时(?:\d{1,2}分?)?(?:\d{1,2}秒)?",
    f"{_YEAR}年{_MONTH}月(?:{_DAY}日?)?",
    f"{_YEAR}[-_/.年]{_MONTH}(?:[-_/.月]{_DAY}日?)?",
    f"{_MONTH}[-_/.月]{_DAY}日?",
    f"{_YEAR}{_TWO_MONTH}(?:{_TWO_DAY}(?:\\d{{4}}|\\d{{6}})?)?",
    r"(?:[01]\d|2[0-3])[0-5]\d",
]
STRUCTURAL = f"^(?:{'|'.join(STRUCTURAL_FORMS)})$"
#: Width of a weight before its term.
_WIDTH = 12


def is_structural(term: Column) -> Column:
    """A date, a time of day, a year or a number of at most two digits, or nothing."""
    return F.trim(F.lower(term)).rlike(STRUCTURAL)


def is_generic(term: Column) -> Column:
    return F.trim(F.lower(term)).isin(GENERIC_TERMS)


def text_terms(text: Column) -> Column:
    """Distinct lexical tokens of a text that can be evidence."""
    return F.filter(c.lexical_tokens(text), lambda x: ~is_structural(x) & ~is_generic(x))


def keyword_terms(keywords: Column) -> Column:
    """Distinct keywords, normalised, and the latin identifiers in them; no structural ones."""
    normal = F.transform(keywords, c.canonical_text)
    latin = F.flatten(F.transform(keywords, lambda k: F.regexp_extract_all(F.lower(F.coalesce(k, F.lit(""))), F.lit("[a-z0-9_-]{2,}"), F.lit(0))))
    return F.filter(F.array_distinct(F.concat(normal, latin)), lambda x: ~is_structural(x))


def _rarity_table(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(space, uid, term, df, n): terms (space, uid, term; distinct) with how many of their space's n items hold them."""
    held = terms.groupBy("space", "term").agg(F.count("*").alias("df"))
    return terms.join(held, ["space", "term"]).join(F.broadcast(sizes), "space")


def _coded(rows: DataFrame, weight: Column, name: str) -> DataFrame:
    """(space, uid, name): the codes of each item's terms, rarest first, in one array."""
    code = F.concat(F.format_string(f"%0{_WIDTH}.9f", weight), F.col("term"))
    return rows.groupBy("space", "uid").agg(F.sort_array(F.collect_list(code), asc=False).alias(name))


def _weight(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0.0), lambda s, x: s + x.substr(1, _WIDTH).cast("double"))


def _term(code: Column) -> Column:
    return code.substr(F.lit(_WIDTH + 1), F.length(code))


def idf_codes(terms: DataFrame, sizes: DataFrame, name: str = "codes") -> DataFrame:
    """Items with their coded terms; a term weighs 1 + ln((n + 1) / (df + 1)). sizes: space, n."""
    rows = _rarity_table(terms, sizes)
    return _coded(rows, 1 + F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), name)


def coded_jaccard(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two coded arrays; 0 if either is empty."""
    shared = _weight(F.array_intersect(a, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(shared / (_weight(a) + _weight(b) - shared))


def term_classes(terms: DataFrame) -> DataFrame:
    """(space, uid, rep): items of one space with the same terms, and the least of them."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set("term")), "\x1f"), 256)
    sets = terms.groupBy("space", "uid").agg(digest.alias("set"))
    return sets.join(sets.groupBy("space", "set").agg(F.min("uid").alias("rep")), ["space", "set"]).select("space", "uid", "rep")


#: Share of a pair's weight by which sums of hashed terms may be off.
SLACK = 1e-4


def _near(codes: DataFrame, threshold: float, size: int | None) -> DataFrame:
    """(space, a, b): pairs that reach the threshold by hashed terms, but for SLACK. Items are dealt to levels of their total, of which only neighbours can meet, and to blocks of them, which are
    written once; what the items of two blocks share in weight is a product of these (`set_blocks`), and no shared term and no other pair becomes a row."""
    size = size or set_blocks.BLOCK_ROWS
    level = F.floor(F.log("total") / F.lit(math.log(1 / threshold) + 1e-6))
    terms = codes.where("total > 0").select("space", "uid", "total", level.alias("level"), F.transform("codes", lambda x: F.xxhash64(_term(x))).alias("terms"), F.transform("codes", lambda x: x.substr(1, _WIDTH).cast("double")).alias("weights"))
    counts = checkpointed(codes.where("total > 0").groupBy("space", level.alias("level")).agg(F.ceil(F.count("*") / size).cast("int").alias("n")))
    name = lambda level, i: F.concat(F.hex(F.xxhash64("space")), F.lit("_"), level.cast("string"), F.lit("_"), i.cast("string"))
    path = set_blocks.written(terms.join(F.broadcast(counts), ["space", "level"]).withColumn("__block", name(F.col("level"), F.pmod(F.xxhash64("uid"), F.col("n")))).drop("n"))
    own = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    same = own.withColumn("j", F.explode(F.sequence("i", F.col("n") - 1))).select(name(F.col("level"), F.col("i")).alias("x"), name(F.col("level"), F.col("j")).alias("y"))
    above = own.join(counts.select("space", (F.col("level") - 1).alias("level"), F.col("n").alias("m")), ["space", "level"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = set_blocks.dealt(checkpointed(same.unionByName(above.select(name(F.col("level"), F.col("i")).alias("x"), name(F.col("level") + 1, F.col("j")).alias("y")))))
    need = threshold / (1 + threshold)

    def run(batches):
        for left, right, same in set_blocks.read_pairs(path, batches, runs=False):
            shared = set_blocks.shared_counts(set_blocks.sets_of(left, "terms", "weights"), set_blocks.sets_of(right, "terms"), len(left), len(right))
            (u, w), (lt, rt) = ([t[x].to_numpy() for t in (left, right)] for x in ("uid", "total"))
            i, j = np.nonzero(shared >= ((need - SLACK) * (lt[:, None] + rt)).astype(np.float32))
            if same:
                i, j = i[u[i] < w[j]], j[u[i] < w[j]]
            a, b = u[i], w[j]
            ids = left.schema.field("uid").type
            yield pa.RecordBatch.from_arrays([left["space"].take(pa.array(i)).combine_chunks(), pa.array(np.where(a < b, a, b), ids), pa.array(np.where(a < b, b, a), ids)], ["space", "a", "b"])

    space, uid = (codes.schema[x].dataType.simpleString() for x in ("space", "uid"))
    return pairs.mapInArrow(run, f"space {space}, a {uid}, b {uid}")


def weighted_jaccard_join(terms: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(space, a, b, similarity): all pairs of a space at the threshold, between the representatives of term_classes, whose members are equal.

    terms: space, uid, term (distinct); rarity is counted over all items. Two items at the threshold share threshold / (1 + threshold) of what both weigh, and neither weighs less than
    threshold times the other. What items share is summed block by block by hashes of the terms, and pairs that reach the threshold so are compared
    by the terms themselves. Work grows with the pairs of items of like weight, rows with the pairs found; an item is written once."""
    terms = checkpointed(terms)
    sizes = terms.groupBy("space").agg(F.countDistinct("uid").alias("n"))
    every = checkpointed(idf_codes(terms, sizes).withColumn("__set", F.sha2(F.array_join("codes", "\x1f"), 256)))
    reps = every.groupBy("space", "__set").agg(F.min("uid").alias("uid")).select("space", "uid")
    codes = checkpointed(every.drop("__set").join(reps, ["space", "uid"], "left_semi").withColumn("total", _weight(F.col("codes"))))
    met = checkpointed(_near(codes, threshold, block))
    whole = lambda n: codes.select("space", F.col("uid").alias(n), F.col("codes").alias("c" + n), F.col("total").alias("t" + n))
    both = met.join(whole("a"), ["space", "a"]).join(whole("b"), ["space", "b"]).select("space", "a", "b", "ta", "tb", _weight(F.array_intersect("ca", "cb")).alias("shared"))
    out = checkpointed(both).withColumn("similarity", F.round(F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared")), 9))
    return out.where(F.col("similarity") >= threshold).select("space", "a", "b", "similarity")


#: What each kind of evidence adds to a pair's selection score.
EVIDENCE_BONUS = {
    "multiple_discriminative_keywords": 0.040, "single_discriminative_keyword": 0.025, "shared_distinctive_identifier": 0.035, "shared_timeline_with_semantic_support": 0.010,
    "weighted_lexical_overlap": 0.025, "strong_reciprocal_semantics": 0.015, "strong_neighborhood_semantics": 0.010, "distinctive_mutual_semantics": 0.020,
}
_FAR = 10**9


def neighbour_pairs(rankings: DataFrame) -> DataFrame:
    """(space, a, b, similarity, rank_a, rank_b, margin_a, margin_b) of pairs that at least one side ranks. rankings: space, uid, other, cosine, rank,
    margin. A side that does not rank the other has a far rank and no margin."""
    a_first = F.col("uid") < F.col("other")
    each = rankings.select("space", F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b"), "cosine", *[F.when(side, x).alias(n) for side, n, x in ((a_first, "ra", F.col("rank")), (~a_first, "rb", F.col("rank")), (a_first, "ma", F.greatest(F.lit(0.0), F.col("margin"))), (~a_first, "mb", F.greatest(F.lit(0.0), F.col("margin"))))])
    both = each.groupBy("space", "a", "b").agg(F.max("cosine").alias("similarity"), F.max("ra").alias("ra"), F.max("rb").alias("rb"), F.max("ma").alias("ma"), F.max("mb").alias("mb"))
    return both.select("space", "a", "b", "similarity", F.coalesce("ra", F.lit(_FAR)).alias("rank_a"), F.coalesce("rb", F.lit(_FAR)).alias("rank_b"), F.coalesce("ma", F.lit(0.0)).alias("margin_a"), F.coalesce("mb", F.lit(0.0)).alias("margin_b"))


def related_topics(rankings: DataFrame, items: DataFrame, keywords: DataFrame, texts: DataFrame, sources: DataFrame, degree: int = 3, threshold: float = 0.60) -> DataFrame:
    """Neighbours with evidence that they are related: the kind of the strongest evidence and a selection score.

    rankings: each item's neighbours, at most max(8, 4 * degree), at the threshold (see neighbour_pairs). items: space, uid, all of them. keywords, texts:
    space, uid, term, distinct and cleaned (keyword_terms, text_terms). sources: space, uid, source.

    A shared keyword counts if at most max(2, 15 % of the space) items hold it and it is not generic; of keywords that contain one another the
    longest counts. Kinds of evidence in order, the first that holds: several keywords; a keyword that is an identifier; one rare keyword;
    weighted overlap of the texts; shared sources with support; high similarity in each other's first `degree`; in each other's neighbours
    in a space of eight; each other's first, clearly."""
    sizes = items.groupBy("space").agg(F.countDistinct("uid").alias("n"))
    n = F.greatest(F.lit(2), F.col("n"))
    rare = _rarity_table(keywords, sizes).where((F.col("df") <= F.greatest(F.lit(2), F.ceil(n * 0.15))) & ~is_generic(F.col("term")))
    words = _coded(rare, F.log((n + 1.0) / (F.col("df") + 1.0)) / F.log(n + 1.0), "words")
    own = items.select("space", "uid").distinct().join(words, ["space", "uid"], "left").join(idf_codes(texts, sizes.withColumn("n", n)), ["space", "uid"], "left")
    own = own.join(sources.groupBy("space", "uid").agg(F.collect_set("source").alias("sources")), ["space", "uid"], "left")
    own = checkpointed(own)
    pairs = neighbour_pairs(rankings).join(sizes, "space")
    for side in "ab":
        pairs = pairs.join(own.select("space", F.col("uid").alias(side), *[F.coalesce(x, F.array()).alias(f"{x}_{side}") for x in ("words", "codes", "sources")]), ["space", side])
    shared = F.array_intersect("words_a", "words_b")
    pairs = pairs.withColumn("__shared", shared)
    distinct = F.filter("__shared", lambda x: ~F.exists("__shared", lambda y: (_term(y) != _term(x)) & _term(y).contains(_term(x))))
    pairs = pairs.withColumn("__kept", distinct).withColumn("lexical", F.round(coded_jaccard(F.col("codes_a"), F.col("codes_b")), 9))
    union = F.size(F.array_union("sources_a", "sources_b"))
    n_sources = F.size(F.array_intersect("sources_a", "sources_b"))
    pairs = pairs.withColumn("source_overlap", n_sources / F.greatest(F.lit(1), union)).withColumn("n_keywords", F.size("__kept"))

    similarity, lexical, limit = F.col("similarity"), F.col("lexical"), max(8, 4 * degree)
    near = lambda k: (F.col("rank_a") <= k) & (F.col("rank_b") <= k)
    core, around, first = near(degree), near(limit), near(1)
    clear = (F.col("n") >= 4) & first & ((similarity >= max(0.78, threshold + 0.12)) | ((similarity >= max(0.72, threshold + 0.10)) & (F.least("margin_a", "margin_b") >= 0.025)))
    identifier = F.exists("__kept", lambda x: _term(x).rlike("^[a-z0-9_-]{2,}$") & _term(x).rlike("[a-z]"))
    strongest = F.coalesce(F.array_max(F.transform("__kept", lambda x: x.substr(1, _WIDTH).cast("double"))), F.lit(0.0))
    fair, good = max(0.62, threshold + 0.02), max(0.68, threshold + 0.08)
    rare_enough = (strongest >= 0.70) | ((strongest >= 0.65) & around)
    supported = (F.col("n_keywords") > 0) | (lexical >= 0.025) | ((F.col("source_overlap") >= 0.50) & (similarity >= 0.78))
    rules = [
        ("multiple_discriminative_keywords", (F.col("n_keywords") >= 2) & (similarity >= fair)),
        ("shared_distinctive_identifier", identifier & (similarity >= threshold)),
        ("single_discriminative_keyword", (strongest >= 0.40) & (similarity >= F.when(rare_enough, fair).otherwise(good))),
        ("weighted_lexical_overlap", (lexical >= 0.08) & (similarity >= good)),
        ("shared_timeline_with_semantic_support", (n_sources > 0) & (similarity >= 0.74) & supported),
        ("strong_reciprocal_semantics", core & (similarity >= 0.81)),
        ("strong_neighborhood_semantics", (F.col("n") >= 8) & around & (similarity >= 0.78)),
        ("distinctive_mutual_semantics", clear),
    ]
    kind = F.coalesce(*[F.when(rule, name) for name, rule in rules])
    bonus = F.coalesce(*[F.when(F.col("evidence_kind") == k, v) for k, v in EVIDENCE_BONUS.items()])
    flag = lambda x, v: F.when(x, v).otherwise(0.0)
    score = similarity + flag(core, 0.035) + flag(around, 0.015) + bonus + F.least(F.lit(0.010), F.col("source_overlap") * 0.01)
    out = pairs.withColumn("evidence_kind", kind).where(F.col("evidence_kind").isNotNull()).withColumn("score", F.round(score, 9))
    return out.select("space", "a", "b", "similarity", "evidence_kind", "score", "rank_a", "rank_b", "n_keywords", F.transform("__kept", _term).alias("keywords"), "lexical", "source_overlap")
