import base64
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliospark.llm import mixing, queries
from foliospark.llm import token_packing as tp

from ..conftest import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_bins(lengths, capacity):
    """Best fit decreasing by looking at every bin."""
    free, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(bins)) if free[b] >= lengths[i]]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            b = len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] -= lengths[i]
    return bins


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_against_brute_force(lengths):
    got, want = tp.best_fit_decreasing(lengths, 50), brute_bins(lengths, 50)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(sum(lengths[i] for i in b) for b in want)


def reference_ids(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tp.VOCAB_PATH, "rb"))}
    e = tiktoken.Encoding("own", pat_str=tp.SPLIT, mergeable_ranks=ranks, special_tokens={})
    return {d: [*e.encode_ordinary(t or ""), max(ranks.values()) + 1] for d, t in texts}


def unpacked(rows):
    parts = defaultdict(dict)
    for r in rows:
        for doc, no, ids in tp.unpack(r):
            parts[doc][no] = list(map(int, ids))
    return {d: [i for no in sorted(p) for i in p[no]] for d, p in parts.items()}


@pytest.mark.parametrize("seq_len,buffer", [(2048, 1 << 20), (16, 100), (1, 50)])
def test_round_trip(spark, seq_len, buffer):
    texts = [(1, "Hello, wörld!  two\n\nlines"), (2, None), (3, ""), (4, "the " * 500), (5, "  x\t y "), (6, "日本語 😀 $$$"), (7, "the " * 500)]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in texts], DOCS)
    rows = tp.pack_documents(df, seq_len=seq_len, rows_per_matrix=3, buffer_tokens=buffer).collect()
    assert unpacked(rows) == reference_ids(texts)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").reshape(r.n_rows, seq_len)
        cu, pos = np.frombuffer(r.cu_seqlens, "<i4"), np.frombuffer(r.position_ids, "<u2")
        assert cu[0] == 0 and cu[-1] == ids.size and (np.diff(cu) > 0).all() and np.diff(cu).max() <= seq_len
        assert sorted(np.flatnonzero(pos == 0)) == sorted(cu[:-1])
        assert sum(r.piece_lens) == r.n_tokens and r.n_rows <= 3


def test_whole_table_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = unpacked(queries.op1_token_packing(spark, SF).collect())
    assert got == reference_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert tp.pack_documents(docs.limit(0)).count() == 0
    nobody = tp.pack_documents(spark.createDataFrame([(None, "hello", None, None, 0)], DOCS)).collect()
    assert unpacked(nobody) == reference_ids([(None, "hello")])
    odd = docs.limit(3).withColumnRenamed("n_chars", "ids").withColumn("doc_id", docs["doc_id"] * 0)
    assert sum(len(r.doc_ids) for r in tp.pack_documents(odd).collect()) >= 3


def test_long_texts_are_cut_where_the_pattern_cuts(monkeypatch):
    text = " a  b\tc d e" * 50 + "\n\n x"
    tok = tp.tokenizer(open(tp.VOCAB_PATH, "rb").read())
    whole = tok.encode(text).tolist()
    monkeypatch.setattr(tp, "pieces", lambda t, cut: __import__("foliospark.llm.common", fromlist=["pieces"]).pieces(t, 7, cut))
    assert tok.encode(text).tolist() == whole == tok.encoding.encode_ordinary(text)


def test_runs_of_white_space_as_the_pattern_has_them():
    tok = tp.tokenizer(open(tp.VOCAB_PATH, "rb").read())
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", "_"]
    texts = [f"{a}{x}{y}{b}" for x in white for y in [*white, ""] for a in ("a", "") for b in ("b", "1", "'s", ".", "")]
    texts += ["if x:\n\n    y \t\n z  \n", "  x", "x  ", " \n ", "a 's  's\r\n\r\n  d"]
    assert [tok.encode(t).tolist() for t in texts] == [tok.encoding.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("sign", " \n")
def test_a_very_long_run_of_white_space(sign):
    tok, n = tp.tokenizer(open(tp.VOCAB_PATH, "rb").read()), 3_000_000
    one = tok.encoding._encode_single_piece
    for text, cut in ((f"a{sign * n} b", ["a", sign * n, " b"]), (sign * n, [sign * n]), (f"a b{sign * n}", ["a", " b", sign * n])):
        assert tok.encode(text).tolist() == [i for piece in cut for i in one(piece)]


# -- mixing


def test_same_as_sql(same_rows):
    same_rows(queries.op10_source_mixing, mixing.mixing_sql())


def brute_poisson(u, rate):
    import math

    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_by_brute_force(spark):
    import hashlib

    rows = [(i, "t", None, "a" if i % 3 else None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter(r.doc_id for r in mixing.mix_sources(df, {"a": 3.0, None: 1.0}, epochs=2.0, seed=5).collect())
    n = Counter(r[3] for r in rows)
    for i, _, _, s, _ in rows:
        u = int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert got[i] == brute_poisson(u, 2.0 * (0.75 if s else 0.25) * 300 / n[s])


def test_mix_edges(spark):
    clash = spark.createDataFrame([(1, "x", "l", "a", 3, 9, 9)], DOCS + ", cdf int, count int")
    assert {(r.cdf, r["count"]) for r in mixing.mix_sources(clash, epochs=3.0).collect()} <= {(9, 9)}
    df = spark.createDataFrame([(None, None, None, "a", 0), (1, "x", "l", "a", 3), (1, "x", "l", "a", 3), (2, "y", None, "none", 1)], DOCS)
    out = mixing.mix_sources(df.withColumn("copy_no", df["n_chars"]), {"a": 1.0}, epochs=5.0).collect()
    counts = Counter(r.doc_id for r in out)
    assert 2 not in counts and counts[1] % 2 == 0 and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "copy_no", "mix_key"}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df, {}).count() == 0
    keys = [r.mix_key for r in mixing.mix_sources(df, epochs=20.0).coalesce(1).collect()]
    assert len(set(keys)) >= len(keys) / 2


def test_shares_meet_the_weights(spark):
    df = spark.createDataFrame([(i, "t", None, "big" if i % 10 else "small", 0) for i in range(5000)], DOCS)
    got = Counter(r.source for r in mixing.mix_sources(df, epochs=1.0).select("source").collect())
    assert abs(got["small"] / sum(got.values()) - 0.5) < 0.03


def test_same_as_sql_at_rates_above_one_draw(spark):
    import duckdb

    rows = [(i, "t", None, "big" if i > 1 else None, 0) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    sql = con.sql(f"select doc_id, count(*) n from ({mixing.mixing_sql()}) group by 1").fetchall()
    assert dict(sql) == Counter(r.doc_id for r in mixing.mix_sources(df).select("doc_id").collect())
    assert dict(sql)[0] > 1000


def test_a_source_made_of_other_columns(spark):
    df = spark.range(200).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', id % 3) as source")
    assert {r.source for r in mixing.mix_sources(df).collect()} == {"s0", "s1", "s2"}


def test_rates_above_one_draw_are_not_cut(spark):
    df = spark.createDataFrame([(i, "t", None, "big" if i > 1 else None, 0) for i in range(6000)], DOCS)
    got = Counter((r.source, r.doc_id if r.source is None else 0) for r in mixing.mix_sources(df).select("source", "doc_id").collect())
    rare = [got[None, 0], got[None, 1]]  # a mean of 1,500 each
    assert all(abs(n - 1500) < 200 for n in rare) and rare[0] != rare[1]
    assert abs(sum(rare) / sum(got.values()) - 0.5) < 0.03
