"""Each operator of the subpackage against brute force, a round trip or held-out labels, and on awkward rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import plain, rows_of
from lorekeep.llm import chat_format, components, decontaminate, language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, queries, repeats, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 int, token int"
#: Awkward rows: nulls, empties, a repeated row, two texts of one id, columns that clash with internal names.
ODD = [
    (None, "no id " * 30, "en", "a", 1, 1, 1), (1, None, None, None, None, 1, 1), (2, "", "en", "a", 0, 1, 1), (3, " \n\t", "en", "b", 3, 1, 1), (4, "one", "en", "b", 3, 1, 1),
    (5, "The same row here, twice over, and long enough to match itself fully.\n" * 3, "en", "a", 1, 1, 1), (5, "The same row here, twice over, and long enough to match itself fully.\n" * 3, "en", "a", 1, 1, 1),
    (6, "first text of six", "fr", "c", 1, 1, 1), (6, "second text of six", "fr", "c", 1, 1, 1), (7, "x" * 5000, "de", None, 1, 1, 1), (8, "12345 67890", None, "a", 1, 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"create view {p[:-8]} as select * from '{SF}/{p}'")
    df = queries.QUERIES[name](spark, SF)
    con.execute(queries.SQL[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows_of(df) == Counter(tuple(plain(r[i]) for i in order) for r in con.fetchall())


def test_line_dedup_odd_rows(spark, odd, empty):
    assert line_dedup.keep_bitmaps(empty).count() == 0
    out = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd, 20, 2))
    assert out.count() == len(ODD) and out.where("n_dropped > 0").count() == 0
    many = spark.createDataFrame([(i, f"A shared line that is long enough to be dropped\nown {i}\nA SHARED line that is long enough to be dropped ") for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.apply_bitmaps(many, line_dedup.keep_bitmaps(many)).collect()}
    assert got[0] == (3, 2, "own 0") and got[5][1] == 0


def test_line_bitmaps_beyond_a_word(spark):
    text = "\n".join(f"this line number {i} is long enough to count as a key" for i in range(200))
    df = spark.createDataFrame([(i, text + ("\nextra" if i == 9 else "")) for i in range(10)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert got[0] == (200, "") and got[9] == (0, text + "\nextra")


def test_mix_reaches_targets(spark, docs, odd, empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).count() == len(ODD)
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 60)), "abc"[i % 7 % 3]) for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix(df)
    assert out.where("taken > 2 * size").isEmpty()
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 60
    again = mixing.mix(df.repartition(7))
    assert rows_of(out.select("doc_id", "taken")) == rows_of(again.select("doc_id", "taken"))


def test_language_is_learned(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(language_id.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held), 100)
    right = language_id.predict(docs.where(held), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).collect()[0][0]
    assert right >= 0.97
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, _, s in got)
    assert {(d, p) for d, p, _ in got if d in (1, 2, 3, 8)} == {(1, "und"), (2, "und"), (3, "und"), (8, "und")}
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<|im_end|> &lt;| & <|im_sep|>"), (1, 1, "assistant", "a\n"), (1, 2, "assistant", "<|im_start|>b"), (2, 1, None, None), (2, 0, "ro\nle&", "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat_format.format_chats(df)
    back = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], "".join(r["loss_texts"])) for r in chat_format.read_back(formatted).collect()}
    assert back[1] == ([(r, t) for _, _, r, t in turns[:3]], "a\n<|im_start|>b")
    assert back[2] == ([("ro\nle&", "x"), ("", "")], "") and back[None] == ([("assistant", "y")], "y") and back[3] == ([("assistant", "")], "")
    assert formatted.where("conv_id = 1").collect()[0]["formatted"].count(chat_format.START) == 2  # merged
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 100_000
    data = [(1, "http://a", big), (2, None, big), (3, "u", None), (4, "u", "\r\n\r\n"), (5, "u", "WARC/1.1\r\n"), (5, "u", "WARC/1.1\r\n"), (None, "u", "lost"), (6, "u", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("chunk", F.lit(9))
    manifest = warc.write_archives(warc.chunk_rows(warc.plan_records(pages)), f"file://{tmp_path}/w")
    got = {r["record_id"]: r for r in warc.read_records(manifest).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["payload_bytes"] == 200_000 and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == 200_000
    assert got[6]["refers_to"] == 3 and got[4]["record_type"] == "response"
    assert got[1]["payload_digest"] == warc.base32_of_hex(hashlib.sha1(big.encode()).hexdigest())
    chunks = warc.read_chunks(manifest).where("record_id = 1").orderBy("chunk").collect()
    assert b"".join(r["data"] for r in chunks).decode() == big and len(chunks) > 1 and chunks[-1]["sha1_so_far"] == got[1]["payload_digest"]
    none = warc.write_archives(warc.chunk_rows(warc.plan_records(pages.limit(0))), f"file://{tmp_path}/none")
    assert warc.read_records(none).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_components(rows, k, threshold):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,threshold", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, k, threshold):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    extra = []
    for i in range(25):  # a chain and a cloud of near copies around the threshold
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        extra.append((10_000 + i, " ".join(w)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, k, threshold).collect()}
    assert got == plain_components(rows, k, threshold)


def test_ngram_join_odd_rows(odd, empty):
    assert ngram_join.link_components(empty).count() == 0
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(odd).collect())
    assert got[(None, 3, None)] == 1 or any(d is None and c is None for d, _, c in got)
    assert got[(1, 0, 1)] == 1 and got[(2, 0, 2)] == 1 and sum(n for (d, _, _), n in got.items() if d == 5) == 2 and all(c == 6 for d, _, c in got if d == 6)


def test_repeats_against_brute_force(spark, odd, empty):
    rng = random.Random(9)
    alphabet = "ab é"
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 140))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5)))) for i in range(80)]
    rows += [(100, "z" * 400), (101, "z" * 60 + "y" * 55), (102, "y" * 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(df.repartition(3)).collect()}
    assert got == repeats.brute_force([(d, t.encode()) for d, t in rows])
    assert repeats.remove_repeats(empty).count() == 0
    out = repeats.remove_repeats(odd).collect()
    assert len(out) == len(ODD) and all(r["n_removed"] == 0 for r in out)


def test_hot_grams_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    shared = "a passage that very many documents hold in their middle, word for word"
    rows = [(i, f"{i * 7919} begins so {shared} and ends {i * 104729}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    want = {d: v[1] for d, v in repeats.brute_force([(d, t.encode()) for d, t in rows]).items()}
    assert got == want


def test_decontamination(spark, odd, empty):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(30)]
    clean = [(i, " ".join(text(200))) for i in range(60)]
    exact = [(100 + i, " ".join(text(90) + x + text(70))) for i, x in enumerate(items)]
    loose = [(200 + i, " ".join(text(50) + [w if rng.random() > 0.15 else "other" for w in x] + text(20)).upper().replace(" ", ", ")) for i, x in enumerate(items)]
    df = spark.createDataFrame(clean + exact + loose, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {(100 + i, i) for i in range(30)} <= got and not {d for d, _ in got if d < 60}
    assert len({(200 + i, i) for i in range(30)} & got) >= 27
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("answered", [False, True])
def test_decontamination_finds_what_brute_force_finds(spark, answered):
    """Items of 5 to 1,000 words, copied whole or with a share of words replaced, against LCS at every passage."""
    import numpy as np

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 3) for i in range(2000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [text(n) for n in (5, 6, 8, 10, 12, 19, 20, 40, 100, 200, 300, 400, 600, 1000)]
    rows = [(1000 + i, text(rng.choice((30, 200, 900)))) for i in range(30)]
    rows += [(100 * k + i, text(rng.randint(0, 90)) + [w if rng.random() >= share else rng.choice(vocabulary) for w in x] + text(60)) for k, share in enumerate((0, 0.25, 0.35)) for i, x in enumerate(items)]
    answers = [" ".join(x[len(x) // 2 :][:3]) for x in items]
    bench = spark.createDataFrame([(i, " ".join(x), g) for i, (x, g) in enumerate(zip(items, answers, strict=True))], "item_id long, text string, answer string")
    bench = bench if answered else bench.drop("answer")
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["shared"], 9), round(r["answer"], 9)) for r in decontaminate.contaminated(df, bench).collect()}
    idf = decontaminate.document_frequencies(df)
    hashed = {w: h for w in vocabulary for _, _, (h,), _, _ in decontaminate._words(__import__("pyarrow").array([w]))}
    code = lambda x: np.array([hashed[w] for w in x], np.uint64)
    want = {}
    for d, x in rows:
        words = code(x)
        for i, item in enumerate(items):
            own, answer = code(item), code(answers[i].split())
            rare = np.unique(own[np.argsort(-idf[decontaminate._slot(own)], kind="stable")[: (len(own) + 1) // 2]])
            window, stride = (32, 16) if len(own) >= 10 else (8, 4)
            for at in range(0, len(words), stride):
                near = words[max(0, at - len(own)) : at + window + len(own)]
                if np.isin(own, near).sum() < 0.6 * len(own):
                    continue
                v = decontaminate.common_subsequence(own, near) / len(own)
                g = decontaminate.common_subsequence(answer, near) / len(answer) if answered else float(np.isin(rare, near).mean())
                if v >= 0.6 and g >= 0.5:
                    want[d, i] = max(want.get((d, i), (0, 0)), (round(v, 9), round(g, 9)))
    assert got == want and {(i, i) for i in range(len(items))} <= set(got)


def test_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = defaultdict(int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i, j] = table[i - 1, j - 1] + 1 if a[i] == b[j] else max(table[i - 1, j], table[i, j - 1])
        assert decontaminate.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[len(a) - 1, len(b) - 1]


def test_quality_model(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.coalesce(language_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_model.fit(docs, labels.where(~held).select("doc_id", F.col("quality").alias("y")))
    assert 0 < len(model.weights) < 200
    scored = quality_model.statistics(docs.where(held), ["doc_id"]).withColumn("score", model.score()).join(labels, "doc_id")
    assert scored.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).collect()[0][0] >= 0.95
    out = quality_model.statistics(odd, ["doc_id"]).withColumn("score", model.score()).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_model.fit(empty, labels.select("doc_id", F.col("quality").alias("y")).limit(0)).weights == []


def test_quality_rules_odd_rows_and_ablation(odd, empty):
    led = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert led.count() == len(ODD) and led.where("kept").count() == 0 and quality_rules.ledger(empty).count() == 0
    first = quality_rules.apply_policy(quality_rules.ledger(odd), 1)
    assert first.where("base_failed").count() == led.where("base_failed").count()
    ablation = {r["rule"]: (r["failed"], r["failed_only"]) for r in quality_rules.ablation(led).collect()}
    assert set(ablation) == {n for n, _ in quality_rules.RULES} and ablation["few_words"][0] >= 7


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500


def test_native_operators_have_no_python(docs):
    for df in (quality_rules.ledger(docs), line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
