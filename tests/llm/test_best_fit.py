import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import best_fit as bf
from foliospark.llm import queries

from ..conftest import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def plain():
    """Ids of a whole text at once."""
    t = Tokenizer.from_file(bf.VOCAB_PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, bf.END_ID]


@pytest.fixture(scope="module")
def encoder():
    return bf.BlankDropping(open(bf.VOCAB_PATH, "rb").read())


def laid_out(rows, capacity):
    """Lengths in each sequence of a plan, checked: no rank twice, no gap, none over."""
    ranks, where = defaultdict(list), defaultdict(list)
    for length, first, last, each, sequence, place in rows:
        for r in range(first, last):
            ranks[length].append(r)
            where[sequence + (r - first) // each].append((place + (r - first) % each * length, length))
    for seen in ranks.values():
        assert sorted(seen) == list(range(len(seen)))
    for inside in where.values():
        at = 0
        for place, length in sorted(inside):
            assert place == at
            at += length
        assert at <= capacity
    assert sorted(where) == list(range(len(where)))
    return {n: len(seen) for n, seen in ranks.items()}, [sorted((n for _, n in v), reverse=True) for v in where.values()]


def fewest_pairs(lengths, capacity):
    """Sequences for large pieces: the longest takes the longest that fits, one by one."""
    left, n = sorted(lengths), 0
    while left:
        long = left.pop()
        mate = max((x for x in left if x + long <= capacity), default=None)
        if mate is not None:
            left.remove(mate)
        n += 1
    return n


def best_fit_by_looking(large_bins, small, capacity):
    free = [capacity - sum(b) for b in large_bins]
    for n in sorted(small, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


@given(st.lists(st.integers(1, 60), max_size=120))
def test_plan_against_one_by_one(lengths):
    counts, bins = laid_out(bf.plan(dict(Counter(lengths)), 60), 60)
    assert counts == dict(Counter(lengths))
    large = [n for n in lengths if 3 * n > 60]
    own = [[n for n in b if 3 * n > 60] for b in bins]
    assert max(map(len, own), default=0) <= 2
    own = [b for b in own if b]
    assert len(own) == fewest_pairs(large, 60)
    assert sorted(60 - sum(b) for b in bins) == best_fit_by_looking(own, [n for n in lengths if 3 * n <= 60], 60)


def test_plan_is_small_and_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = Counter(np.clip(rng.lognormal(6, 1.2, 2_000_000).astype(int) + 1, 1, 4096).tolist())
    rows = bf.plan(dict(lengths), 4096)
    bound = -(-sum(n * c for n, c in lengths.items()) // 4096)
    sequences = max(s + (last - first - 1) // each for _, first, last, each, s, _ in rows) + 1
    assert len(rows) < 6 * 4096 and bound <= sequences <= bound * 1.001


def test_plan_refuses_lengths_beyond():
    with pytest.raises(ValueError):
        bf.plan({5: 1}, 4)
    assert bf.plan({}, 4) == [] and bf.plan({4: 0}, 4) == []


ODD = ["Hello,  WÖRLD!\tit's 2024", None, "", " \n ", "x" * 5000, "日本語 テキスト", "a<|endoftext|>b <|startoftext|>", "é ́x y z\x1cq\x85w", "they'll've " * 3000, "Σ ΑΣ ΑΣ.", "the " * 9000]


def test_pieces_against_whole_texts(spark, plain):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ODD)] + [(4, "the", "extra", None, 0), (None, "the", None, None, 0)], DOCS)
    rows = bf.pack(docs, seq_len=512).collect()
    found = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start == r.piece * 512
        assert r.length == 512 or r.length == len(ids)
        if r.doc_id is not None and r.doc_id != 4:
            found[r.doc_id][r.piece] = ids.tolist()
    for i, text in enumerate(ODD):
        if i != 4:
            assert [x for k in sorted(found[i]) for x in found[i][k]] == plain(text), text
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 4 and r.piece == 0 for r in rows) == 2
    whole = {s.sequence_id: s for s in bf.sequences(bf.pack(docs, seq_len=512)).collect()}
    assert sum(sum(s.lengths) for s in whole.values()) == sum(r.length for r in rows)
    assert all(len(s.ids) == 4 * sum(s.lengths) <= 4 * 512 for s in whole.values())


def test_texts_over_a_piece(spark, plain, monkeypatch):
    monkeypatch.setattr(bf, "CACHE_CHUNKS", 3)
    monkeypatch.setattr("foliospark.llm.common.CHUNK_CHARS", 7)
    tok = bf.BlankDropping(open(bf.VOCAB_PATH, "rb").read())
    for some in ([t] for t in ODD), [ODD]:
        for texts in some:
            got = tok.encode([(t or "").encode() for t in texts])
            assert [[*ids.tolist(), bf.END_ID] for ids in got] == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ9 -'sStTéÀß×÷ſŉıŒ́İΣ日\x00\x0b\x1c\x7f\xa0<|>.,\n"), max_size=40))
def test_any_text(encoder, plain, text):
    assert [*encoder.encode([text.encode()])[0].tolist(), bf.END_ID] == plain(text)


def test_every_token_comes_out_of_its_own_merge():
    """What makes ranks do for merges: before a token's merge is its turn, its own bytes are the two tokens that it is made of."""
    model = json.load(open(bf.VOCAB_PATH))["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {pair: k for k, pair in enumerate(merges)}
    symbols = {}
    for k, (a, b) in enumerate(merges):
        parts = symbols.get(a, [a]) + symbols.get(b, [b])
        assert all(len(x.removesuffix("</w>")) == 1 for x in parts)
        symbols[a + b] = parts
        while True:
            pairs = list(zip(parts, parts[1:]))
            pair = min(pairs, key=lambda p: rank.get(p, k), default=None)
            if pair is None or rank.get(pair, k) >= k:
                break
            at, joined = 0, []
            while at < len(parts):
                n = 2 if tuple(parts[at : at + 2]) == pair else 1
                joined.append("".join(parts[at : at + n]))
                at += n
            parts = joined
        assert parts == [a, b]


def test_special_tokens_in_texts(encoder, plain):
    for text in ("<|endoftext|>", "x<|startoftext|>Y", "<|ENDOFTEXT|>", "a<|ENDOFTEXT|>b <|endoftext|>C"):
        assert [*encoder.encode([text.encode()])[0].tolist(), bf.END_ID] == plain(text)


def test_clashing_columns_and_equal_rows(spark):
    names = ["part", "length", "ids", "sequence_id", "rank", "offset", "no", "before"]
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id bigint, text string").withColumns({n: F.lit("x") for n in names})
    got = bf.pack(df, seq_len=4).collect()
    assert got[0].__fields__ == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert sorted((r.doc_id, r.length) for r in got) == [(1, 3), (1, 3), (2, 2)]


def test_empty_table(spark):
    assert bf.pack(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        bf.pack(spark.createDataFrame([], DOCS), seq_len=0)


def test_query_over_all_documents(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_best_fit_packing(spark, SF).collect()
    want = {}
    for doc, text in texts.items():
        ids = plain(text)
        for k, at in enumerate(range(0, len(ids), 4096)):
            some = np.array(ids[at : at + 4096], "<u4")
            want[doc, k] = (at, len(some), zlib.crc32(some.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1
