"""Terms, weighted overlap and the evidence of related topics, each against a plain computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import columns as c
from lorekeep.operators import relations

STRUCTURAL = ["", "年", "7", "31", "2024", "1999", "8:30", "12：05:59", "9时", "9时30分", "9时30分5秒", "2024年5月", "2024年5月3日", "2024-05", "2024/5/3", "2024.12.31", "5月3日", "12-31", "202405", "20240503", "202405031230", "20240503123059", "0930", "2359", " 2024 "]
NAMES = ["expo2026", "2024年13月", "1700", "2024-13", "13-40", "123", "20241303", "3d", "第5", "8:3", "2460", "99999999", "5月32日", "年度", "24-00"]


def test_structural_terms(spark):
    df = spark.createDataFrame([(t,) for t in STRUCTURAL + NAMES], "t string").select("t", relations.is_structural(F.col("t")).alias("s"))
    got = {r["t"]: r["s"] for r in df.collect()}
    assert [t for t in STRUCTURAL if not got[t]] == [] and [t for t in NAMES if got[t] and t not in ("1700",)] == []


def test_tokens_and_keywords(spark):
    df = spark.createDataFrame([("我们 计划 Go to 上海X 2024 a b_1 㐀", ["Café 12", "Expo-2026 in 上海", None, "2024"])], "t string, k array<string>")
    r = df.select(c.lexical_tokens(F.col("t")), relations.text_terms(F.col("t")), relations.keyword_terms(F.col("k"))).first()
    assert sorted(r[0]) == sorted(["我们", "计划", "go", "to", "上海", "2024", "b_1", "㐀"]) and sorted(r[1]) == sorted(["go", "to", "上海", "b_1", "㐀"])
    assert sorted(r[2]) == sorted(["café12", "caf", "expo2026in上海", "expo-2026", "in"])


def weights(sets):
    n = len(sets)
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    return {t: 1 + math.log((n + 1) / (k + 1)) for t, k in df.items()}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7])
def test_weighted_join_equals_all_pairs(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    spaces = {s: {} for s in "xy"}
    for s, sets in spaces.items():
        for u in range(70):
            base = sets[rng.randrange(u)] if u and rng.random() < 0.6 else set()
            sets[u] = ({w for w in base if rng.random() < 0.85} | {rng.choice(words) for _ in range(rng.randrange(0, 4))} | {"common"}) if rng.random() > 0.1 else set(base) or {"common"}
    terms = spark.createDataFrame([(s, u, t) for s, sets in spaces.items() for u, own in sets.items() for t in own], "space string, uid long, term string")
    got = {(r["space"], r["a"], r["b"]): r["similarity"] for r in relations.weighted_jaccard_join(terms, threshold).collect()}
    classes = {(r["space"], r["uid"]): r["rep"] for r in relations.term_classes(terms).collect()}
    want = {}
    for s, sets in spaces.items():
        w = weights(sets)
        assert all(classes[s, u] == min(v for v in sets if sets[v] == own) for u, own in sets.items())
        reps = [u for u in sets if classes[s, u] == u]
        for a in reps:
            for b in reps:
                if a < b:
                    j = sum(w[t] for t in sets[a] & sets[b]) / sum(w[t] for t in sets[a] | sets[b])
                    if round(j, 9) >= threshold:
                        want[s, a, b] = j
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got) and (len(got) > 5 or threshold > 0.6)


def plain_rule(pair, sets, words, sources, n, degree=3, threshold=0.6):
    a, b, sim, ra, rb, ma, mb = pair
    limit, w = max(8, 4 * degree), weights(words)
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    shared = {t for t in sets[a] & sets[b] if df[t] <= max(2, math.ceil(n * 0.15)) and t not in relations.GENERIC_TERMS}
    kept = [t for t in shared if not any(t != o and t in o for o in shared)]
    rarity = max((math.log((n + 1) / (df[t] + 1)) / math.log(n + 1) for t in kept), default=0)
    union = words[a] | words[b]
    lexical = sum(w[t] for t in words[a] & words[b]) / sum(w[t] for t in union) if words[a] and words[b] else 0
    common = sources[a] & sources[b]
    overlap = len(common) / max(1, len(sources[a] | sources[b]))
    core, around, first = (ra <= degree and rb <= degree), (ra <= limit and rb <= limit), (ra == 1 and rb == 1)
    kind = None
    if len(kept) >= 2 and sim >= 0.62:
        kind = "multiple_discriminative_keywords"
    elif any(t.isascii() and any(x.isalpha() for x in t) and len(t) > 1 for t in kept) and sim >= threshold:
        kind = "shared_distinctive_identifier"
    elif kept and rarity >= 0.4 and sim >= (0.62 if rarity >= 0.7 or (rarity >= 0.65 and around) else 0.68):
        kind = "single_discriminative_keyword"
    elif lexical >= 0.08 and sim >= 0.68:
        kind = "weighted_lexical_overlap"
    elif common and sim >= 0.74 and (kept or lexical >= 0.025 or (overlap >= 0.5 and sim >= 0.78)):
        kind = "shared_timeline_with_semantic_support"
    elif core and sim >= 0.81:
        kind = "strong_reciprocal_semantics"
    elif n >= 8 and around and sim >= 0.78:
        kind = "strong_neighborhood_semantics"
    elif n >= 4 and first and (sim >= 0.78 or (sim >= 0.72 and min(ma, mb) >= 0.025)):
        kind = "distinctive_mutual_semantics"
    return kind, kind and round(sim + 0.035 * core + 0.015 * around + relations.EVIDENCE_BONUS[kind] + min(0.01, overlap * 0.01), 9)


def test_related_topics_equal_a_plain_computation(spark):
    rng = random.Random(11)
    n, kinds = 30, set()
    uids = range(n)
    words = {u: {f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 9))} for u in uids}
    keys = {u: set(rng.sample(["甲乙", "甲乙丙", "丁戊", "计划", "alpha", "al", "己", "庚辛"], rng.choice([0, 0, 0, 1, 1, 2, 3]))) for u in uids}
    sources = {u: {rng.randrange(25) for _ in range(rng.randrange(0, 4))} for u in uids}
    ranked, sims = [], {}
    for u in uids:
        others = rng.sample([v for v in uids if v != u], 14)
        for v in others:
            sims.setdefault((min(u, v), max(u, v)), round(rng.uniform(0.6, 0.86), 3))
    near = {u: sorted([(-s, b if a == u else a) for (a, b), s in sims.items() if u in (a, b)])[:12] for u in uids}
    margin = {}
    for u, row in near.items():
        for k, (s, v) in enumerate(row):
            margin[u, v] = (k + 1, max(0.0, -s - (-row[k + 1][0] if k + 1 < len(row) else 0.6)))
            ranked.append(("s", u, v, -s, k + 1, margin[u, v][1]))
    terms = lambda sets: spark.createDataFrame([("s", u, t) for u, own in sets.items() for t in own], "space string, uid long, term string")
    items = spark.createDataFrame([("s", u) for u in uids], "space string, uid long")
    src = spark.createDataFrame([("s", u, t) for u, own in sources.items() for t in own], "space string, uid long, source long")
    out = relations.related_topics(spark.createDataFrame(ranked, "space string, uid long, other long, cosine double, rank int, margin double"), items, terms(keys), terms(words), src)
    got = {(r["a"], r["b"]): (r["evidence_kind"], r["score"]) for r in out.collect()}
    for (a, b), sim in sims.items():
        if (a, b) not in margin and (b, a) not in margin:
            assert (a, b) not in got
            continue
        (ra, ma), (rb, mb) = margin.get((a, b), (10**9, 0.0)), margin.get((b, a), (10**9, 0.0))
        kind, score = plain_rule((a, b, sim, ra, rb, ma, mb), keys, words, sources, n)
        kinds.add(kind)
        assert got.get((a, b), (None, None))[0] == kind and (kind is None or abs(got[a, b][1] - score) < 1e-6), (a, b)
    assert len(kinds) >= 7


def test_nothing_in_nothing_out(spark):
    terms = spark.createDataFrame([], "space string, uid long, term string")
    assert relations.weighted_jaccard_join(terms, 0.6).count() == 0
    ranked = spark.createDataFrame([], "space string, uid long, other long, cosine double, rank int, margin double")
    assert relations.related_topics(ranked, terms.select("space", "uid"), terms, terms, spark.createDataFrame([], "space string, uid long, source long")).count() == 0


def test_weighted_join_makes_no_row_of_a_shared_term(spark, monkeypatch):
    """Items with a rare word in common and little else never become rows; blocks of any size give the same pairs."""
    words = {u: {"shared", *(f"own{u}-{i}" for i in range(6))} for u in range(40)}
    words[40] = (words[0] - {"own0-0"}) | {"other"}
    terms = spark.createDataFrame([("x", u, t) for u, own in words.items() for t in own], "space string, uid long, term string")
    tables = []
    monkeypatch.setattr(relations, "checkpointed", lambda df, plain=relations.checkpointed: tables.append(plain(df)) or tables[-1])
    got = [sorted(tuple(r) for r in relations.weighted_jaccard_join(terms, 0.5, block).collect()) for block in (3, 1000)]
    assert got[0] == got[1] and [r[1:3] for r in got[0]] == [(0, 40)]
    assert [df.count() for df in tables if df.columns == ["space", "a", "b"]] == [1, 1]
