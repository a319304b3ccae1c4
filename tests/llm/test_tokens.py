"""Operators 11 to 13: fill in the middle, alignment of tokenizers, files of token ids; each against a plainer computation."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import alignment, fill_middle, token_files
from lorekeep.llm.encoding import BYTE_BPE, PIECE_BPE, ByteBpe, PieceBpe, Stretches

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "no id here", 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, " \n\t  ", 1, "x"), (4, "one", 1, "x"), (5, "the same row", 1, "x"), (5, "the same row", 1, "x"), (6, "first of six", 1, "x"),
    (6, "second of six", 1, "x"), (7, "<P> and <S> and <M>", 1, "x"), (8, "a <|endoftext|> b</s> <s>▁x", 1, "x"), (9, "  two  spaces \n and\r\n\r\n lines  ", 1, "x"), (10, "é 漢字 👩‍👩‍👧 ​\x1c x\x00y", 1, "x"), (11, "word " * 60_000, 1, "x"), (12, "y" * 3_000, 1, "x"), (13, "don't we'll 1a 12.5 x_y ...!?", 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n long, form string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fim(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_odd_rows(odd):
    df = fill_middle.fill_in_middle(odd)
    got = df.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == sorted((str(d), *fim(d, t)) for d, t, *_ in ODD)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, *_ in ODD)
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_fill_in_middle_sentinels_at_cuts(spark):
    # texts that hold parts of sentinels, so that a cut may stand next to one
    df = spark.createDataFrame([(i, "<P<S<M>P>S>M>"[: i % 14] * (i % 5)) for i in range(600)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(df)
    back = out.join(df, "doc_id").where(fill_middle.restored(F.col("output"), F.col("form")) != F.col("text"))
    assert back.count() == 0 and {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [r"(?s:.)", r"\s*\S+\s*|\s+"])
def test_stretches_of_units_equal_one_match(unit):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab \né漢") for _ in range(rng.randrange(60)))
        h1, h2 = rng.randrange(2**32), rng.randrange(2**32)
        whole = regex.compile(f"({unit})*")
        want = fill_middle.unit_cuts(text, h1, h2, whole, None, 1000)
        for size in (1, 2, 7):
            assert fill_middle.unit_cuts(text, h1, h2, whole, regex.compile(f"({unit}){{0,{size}}}"), size) == want


def test_fill_in_middle_very_long_text(spark):
    text = "naïve text 漢\n" * 120_000
    got = fill_middle.fill_in_middle(spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string"), stretch=100_000).collect()
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == sorted((k, *fim(k, text)) for k in range(4))


TEXT = st.text(st.sampled_from(list(" \n\t\r.,'a1zé▁漢\x1c\x85  <|>s-_")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_stretches_give_the_ids_of_whole_texts(texts):
    for specials in (False, True):
        tokenizer = ENCODERS[specials].tokenizers[0]
        (ids, sizes), _ = ENCODERS[specials].encode(pa.array(texts, pa.string()))[0][0], None
        want = [e.ids for e in tokenizer.library.encode_batch([(" " if specials else "") + t for t in texts], add_special_tokens=False)] if texts else []
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    (ids, sizes), valid = ENCODERS[True].encode(pa.array(texts, pa.string()))[0][1], ENCODERS[True].encode(pa.array(texts, pa.string()))[1]
    piece = ENCODERS[True].tokenizers[1]
    whole = [piece.library.encode(t) for t in texts]
    for t, w, n, ok in zip(texts, whole, sizes, valid):
        same = b"".join(piece.bytes_of[i] for i in w) == (" " + t).encode()
        assert not t or ok == same
    if all(valid) and all(texts):
        assert ids.tolist() == [i for w in whole for i in w]


ENCODERS = {False: Stretches([ByteBpe(BYTE_BPE, False)]), True: Stretches([ByteBpe(BYTE_BPE, True), PieceBpe(PIECE_BPE)], lead=True, check=True)}


def brute_files(rows):
    library = ByteBpe(BYTE_BPE, False).library
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_whole_encoding(spark, docs, monkeypatch, tmp_path):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = brute_files(rows)
    for k, size in enumerate((token_files.BLOCK_IDS, 500)):
        got = token_files.read_digests(token_files.write(docs, f"file://{tmp_path}/{k}", block_ids=size)).collect()
        assert sorted(map(tuple, got)) == want


def test_token_files_odd_rows(spark, odd, tmp_path):
    manifest = token_files.write(odd, f"file://{tmp_path}/odd", block_ids=10)
    got = sorted(map(tuple, token_files.read_digests(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d))
    want = {r[0]: r[2:] for r in brute_files([(d, t) for d, t, *_ in ODD if d not in (5, 6)])}
    assert all(r[2:] == want[r[0]] for r in got if r[0] in want)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert token_files.read_digests(token_files.write(odd.limit(0), f"file://{tmp_path}/none")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repair_round_trip_and_ranges(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        ids = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 3000))).astype(np.uint32)
        rules, symbols = token_files.repair(ids, 6, 2, 5)
        assert np.array_equal(token_files.Grammar(rules, 6).expand(symbols), ids)
        block = token_files.Block(token_files.pack_block([3, None], np.array([1, len(ids) - 1]), ids, 6))
        assert np.array_equal(block.ids(), ids) and block.doc_ids == [3, None]
        for _ in range(5):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(block.decode_range(a, b), ids[a:b])


def test_repair_shortens_and_refuses_cut_blocks():
    ids = np.tile(np.arange(7, dtype=np.uint32), 4000)
    data = token_files.pack_block([1], np.array([len(ids)]), ids, 7)
    assert len(data) < len(ids) / 2
    with pytest.raises(ValueError):
        token_files.Block(data[:-1])


def repeated_pairs(symbols):
    """Pairs of neighbours that occur twice without overlap."""
    times, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != i - 1:
            times[pair], last[pair] = times.get(pair, 0) + 1, i
    return [p for p, n in times.items() if n > 1]


@pytest.mark.parametrize("seed", range(3))
def test_repair_goes_on_until_no_pair_occurs_twice(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 50, 400, 5000):
        ids = rng.integers(0, int(rng.integers(1, 60)), n).astype(np.uint32)
        rules, symbols = token_files.repair(ids, 60)
        assert np.array_equal(token_files.Grammar(rules, 60).expand(symbols), ids)
        assert not repeated_pairs(symbols.tolist())
        assert np.array_equal(token_files.expansion_lengths(rules, 60), token_files.Grammar(rules, 60).sizes)


def ends(ids, tokenizer):
    return np.cumsum([len(tokenizer.bytes_of[i]) for i in ids])


def brute_alignment(texts):
    """Per text: n_a, n_b, groups, links; all pairs of tokens compared, texts encoded whole."""
    a_of, b_of = ENCODERS[True].tokenizers
    out = []
    for t in texts:
        full = " " + (t or "")
        a, b = a_of.library.encode(full, add_special_tokens=False).ids, b_of.library.encode(t or "")
        if not t or any(b"".join(x.bytes_of[i] for i in ids) != full.encode() for x, ids in ((a_of, a), (b_of, b))):
            out.append((0, 0, "", []))
            continue
        ea, eb = ends(a, a_of).tolist(), ends(b, b_of).tolist()
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            k, m = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def check_alignment(df, texts):
    aligned = brute_alignment([t for _, t in texts])
    counts = {}
    for *_, links in aligned:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    want = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(texts, aligned):
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        want.append((str(doc_id), n_a, n_b, groups.count("|"), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest))
    for broadcast_pairs in (1 << 22, 0):
        for work in (1 << 15, 3):
            got = alignment.align_tokenizers(df, work=work, broadcast_pairs=broadcast_pairs).collect()
            assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want), (broadcast_pairs, work)


def test_alignment_odd_rows(spark, odd):
    short = odd.where("doc_id is null or doc_id <> 11")
    check_alignment(short, [(d, t) for d, t, *_ in ODD if d != 11])
    assert alignment.align_tokenizers(odd.limit(0)).count() == 0


def test_alignment_documents(spark, docs):
    rows = docs.where(F.length("text") < 3000).orderBy("doc_id").limit(60)
    check_alignment(rows, [(r["doc_id"], r["text"]) for r in rows.collect()])


def test_very_long_text_aligns_in_pieces(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenization, naïvely\n" * 12_000)], "doc_id long, text string")
    one, many = (alignment.align_tokenizers(df, work=w).collect() for w in (1 << 30, 1 << 12))
    assert one == many and one[0]["n_links"] > 100_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_pieces_equal_one_merge(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    total = max(a[-1], b[-1])
    a, b = (x if x[-1] == total else np.append(x, total) for x in (a, b))
    got = [x.tolist() for x in alignment.align(a, b, work)]
    union = sorted({*a.tolist(), *b.tolist()})
    common = sorted({*a.tolist()} & {*b.tolist()})
    assert got == [[int((a < e).sum()) for e in union], [int((b < e).sum()) for e in union], [sum(c < e for c in common) for e in union]]
    i, j = alignment.diagonals(a, b, work)
    assert all(abs(d) <= work + 1 for d in np.diff(i + j))
