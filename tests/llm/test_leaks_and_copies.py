import random
from collections import defaultdict

import numpy as np
import pytest

from foliospark.llm import decontamination as dc
from foliospark.llm import near_dedup as nd
from foliospark.llm import queries
from foliospark.llm.common import WordHashes, pieces, words

from ..conftest import SF


def brute_alignment(a, b, match=2, mismatch=-1, gap=-1):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y and x else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
        best = max(best, *row)
    return best


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 30))
        assert dc.smith_waterman(a, b) == brute_alignment(a.tolist(), b.tolist())


def test_every_window_keeps_a_seed():
    items = dc.Items([(1, "a b c d e f g h i j k l")], 3)
    grams = items.grams(items.seqs[0])
    order = np.argsort(grams)
    places = dc.choose_seeds(items, grams[order], order, 4).place
    assert all(any(s <= p < s + 4 for p in places) for s in range(7))


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_any_length_of_seeds_and_any_number_of_words(spark, n):
    rng = random.Random(n)
    bench = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for i in range(400)]  # about 16,000 different words
    docs = [(i, "before " + bench[i][1] + " after") for i in range(0, 400, 40)] + [(1000, "nothing of them")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in dc.find_leaks(d, b, n=n).collect()} == {(i, i, 1.0) for i in range(0, 400, 40)}


def test_blocks_don_t_grow_with_one_item_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dc, "_block", lambda texts, rows, n, window: seen.append(sum(len(t) for _, t in rows)) or iter(()))
    b = spark.createDataFrame([(1, f"text number {i:04d} of one item") for i in range(500)], "item_id bigint, text string")
    assert list(dc._blocks(b.select("text"), b, 3, 4, 1000)) == [] and max(seen) < 1000 + 30 and sum(seen) == 500 * 28


def test_leaks_in_a_very_long_document_and_ties(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 3000)
    item = " ".join(rng.sample(vocab, 30))
    long = [rng.choice(vocab) for _ in range(300_000)]
    long[200_000:200_000] = item.split()
    d = spark.createDataFrame([(1, " ".join(long)), (2, "same words " * 20)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item), (2, "same words same words same words same words"), (3, "same words same words same words same words")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in dc.find_leaks(d, b).collect()} >= {(1, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0)}


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_leaks_exact_edited_and_frequent(spark):
    rng = random.Random(3)
    vocab = vocabulary(rng, 2000)
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [(i, " ".join(say(30))) for i in range(20)]
    docs = [(i, " ".join(say(120))) for i in range(300)]
    for i in range(20):  # exact, other case and marks
        docs.append((1000 + i, " ".join(say(50)) + " " + ", ".join(bench[i][1].upper().split()) + "! " + " ".join(say(50))))
    for i in range(20):  # every sixth word replaced, one dropped
        w = bench[i][1].split()
        w = [rng.choice(vocab) if j % 6 == 3 else x for j, x in enumerate(w) if j != 13]
        docs.append((2000 + i, " ".join(say(50) + w + say(50))))
    docs += [(3000 + i, " ".join(say(5)) + " " + bench[0][1]) for i in range(200)]  # a third holds one item
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.find_leaks(df, b).collect()}
    assert {(1000 + i, i) for i in range(20)} | {(2000 + i, i) for i in range(20)} | {(3000 + i, 0) for i in range(200)} == set(got)
    assert all(s == 1.0 for (d, _), s in got.items() if d < 2000 or d >= 3000)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(df, b, block_chars=600).collect()} == set(got)
    assert sorted(r.doc_id for r in dc.remove_leaks(df, b).collect()) == list(range(300))
    brute = {}
    for d, t in docs[:330]:
        for i, x in bench:
            names = {w: k for k, w in enumerate(words(x), 1)}
            a = [names.get(w, 0) for w in words(x)]
            score = brute_alignment(a, [names.get(w, 0) for w in words(t)]) / (2 * len(a))
            if score >= 0.5:
                brute[d, i] = score
    assert brute == {k: v for k, v in got.items() if k[0] in {d for d, _ in docs[:330]}}


@pytest.mark.parametrize("every", [4, 5])
def test_edited_copies_of_items_without_an_exact_copy(spark, every):
    rng = random.Random(every)
    vocab = sorted(set(vocabulary(rng, 6000)))
    bench = [(i, " ".join(rng.sample(vocab, rng.randint(24, 55)))) for i in range(30)]
    other = ["zz" + w for w in vocab]
    docs = [(i, " ".join(rng.choice(other) for _ in range(100))) for i in range(50)]
    for i, t in bench:
        w = [rng.choice(other) if j % every == every - 1 else x for j, x in enumerate(t.split())]
        docs.append((1000 + i, " ".join([rng.choice(other) for _ in range(40)] + w)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(d, b).collect()} == {(1000 + i, i) for i, _ in bench}
    assert sorted(r.doc_id for r in dc.remove_leaks(d, b).collect()) == list(range(50))


def test_leak_edges(spark):
    b = spark.createDataFrame([(1, "one two three four five"), (None, "one two three four five"), (2, None), (3, "hi")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, None), (None, "one two three four five"), (2, ""), (3, "hi"), (4, "one two three four five"), (4, "one two three four six")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in dc.find_leaks(d, b).collect()} == {(4, 1, 1.0), (3, 3, 1.0)}  # a short item is found as a whole
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0
    assert dc.remove_leaks(d, b).count() == 2 and dc.remove_leaks(d, b.limit(0)).count() == 6


# -- near duplicates


def test_leaks_with_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {item} after", 5, "x", None), (2, "nothing of it", 6, "y", 1.0)], "doc_id bigint, text string, item_id int, words string, score double")
    bench = spark.createDataFrame([(9, item, 3, "z")], "item_id bigint, text string, doc_id int, words string")
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()] == [(1, 9)]
    assert [tuple(r) for r in dc.remove_leaks(docs, bench).collect()] == [(2, "nothing of it", 6, "y", 1.0)]


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    s = nd.Sampler(4000)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    wa = rng.uniform(1, 10, 300)
    b, wb = a[60:], wa[60:] * rng.uniform(0.7, 1.4, 240)
    truth = nd.weighted_jaccard((np.sort(a), wa[np.argsort(a)]), (np.sort(b), wb[np.argsort(b)]))
    assert abs((s.signature(a, wa) == s.signature(b, wb)).mean() - truth) < 0.04


def test_weighted_shingles_by_brute_force():
    idf = np.random.default_rng(1).uniform(1, 9, 1 << nd.DF_BITS)
    text = "the cat sat on the mat the cat sat on the mat and so on"
    h = WordHashes().of(text)
    got = dict(zip(*nd.weighted_shingles(h, idf), strict=True))
    want = defaultdict(float)
    slot = [idf[int(x) >> (64 - nd.DF_BITS)] for x in h]
    from foliospark.llm.common import ngram_hashes

    for i, g in enumerate(ngram_hashes(h, 5)):
        want[g] += sum(slot[i : i + 5]) / 5
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    assert len(nd.weighted_shingles(WordHashes().of("two words"), idf)[0]) == 1 and len(nd.weighted_shingles(WordHashes().of(" !"), idf)[0]) == 0


def brute_classes(docs, idf):
    """Connected components of all pairs by their weighted similarity."""
    sets = {d: nd.weighted_shingles(WordHashes().of(t or ""), idf) for d, t in docs}
    label = {d: d for d, _ in docs}
    find = lambda d: d if label[d] == d else find(label[d])
    ids = [d for d, _ in docs]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if nd.weighted_jaccard(sets[a], sets[b]) >= nd.MIN_SIMILARITY:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in ids}


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    vocab = vocabulary(rng, 3000)
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    common = say(60)
    docs = [(i, " ".join(say(80))) for i in range(60)]
    docs += [(100 + i, " ".join(common + say(60))) for i in range(40)]  # a shared passage, not copies
    base = say(150)
    for i in range(60):  # one large group of near copies
        w = list(base)
        w[rng.randrange(150)] = rng.choice(vocab)
        docs.append((200 + i, " ".join(w)))
    docs += [(300 + i, docs[0][1].upper()) for i in range(30)]  # exact but for the case
    docs += [(400, ""), (401, None), (402, " !"), (403, "one two"), (404, "One, two")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    want = brute_classes(docs, nd.inverse_frequencies(df.select("text")))
    assert got == want
    assert {r.doc_id for r in nd.keep_one_each(df).collect()} == set(want.values())
    small = {r.doc_id: r.class_id for r in nd.near_duplicates(df, small=2).collect()}  # every bucket is large
    assert small == want


def banded_classes(df, idf, bands, rows):
    """Connected components of all pairs that share a band, by brute force."""
    class Idf:
        value = idf

    signed = nd.signatures(df, Idf, bands, rows).collect()
    text = dict((r.doc_id, r.text) for r in df.collect())
    sets = {d: nd.weighted_shingles(WordHashes().of(t), idf) for d, t in text.items()}
    buckets = defaultdict(list)
    for r in signed:
        for no in range(bands):
            buckets[no, r[f"band_{no}"]].append(r.doc_id)
    label = {d: d for d in text}
    find = lambda d: d if label[d] == d else find(label[d])
    for a, b in {(a, b) for m in buckets.values() for a in m for b in m if a < b}:
        if nd.weighted_jaccard(sets[a], sets[b]) >= nd.MIN_SIMILARITY:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {d: find(d) for d in text}, max(map(len, buckets.values()))


def test_links_through_other_members_than_the_smallest(spark):
    rng = random.Random(11)
    vocab = vocabulary(rng, 3000)

    def near(w, n):
        w = list(w)
        for at in rng.sample(range(len(w)), n):
            w[at] = rng.choice(vocab)
        return w

    docs, base = [], [rng.choice(vocab) for _ in range(200)]
    family = [near(base, 2) for _ in range(150)]
    docs += [(i, " ".join(w)) for i, w in enumerate(family)]
    docs += [(500 + i, " ".join(near(rng.choice(family[1:]), 4))) for i in range(60)]  # many are like some members, few like the smallest
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want, largest = banded_classes(df, nd.inverse_frequencies(df.select("text")), nd.BANDS, nd.ROWS)
    assert largest > nd.SMALL
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == want


def test_pairs_that_meet_in_a_single_large_bucket(spark):
    rng = random.Random(12)
    vocab = vocabulary(rng, 3000)
    common, docs = [rng.choice(vocab) for _ in range(110)], []
    for i in range(120):  # a shared passage makes large buckets; each text has one near copy
        w = common + [rng.choice(vocab) for _ in range(40)]
        docs += [(i, " ".join(w)), (1000 + i, " ".join(w[:-1]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want, largest = banded_classes(df, nd.inverse_frequencies(df.select("text")), 1, 1)
    assert largest > nd.SMALL and 120 <= len(set(want.values())) < 200
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df, bands=1, rows=1).collect()} == want


def test_large_buckets_in_several_blocks(spark, monkeypatch):
    """Blocks of a few texts, hot keys broadcast or not: the same classes as with every pair of every bucket."""
    from foliospark import session

    rng = random.Random(13)
    vocab = vocabulary(rng, 3000)
    base, docs = [rng.choice(vocab) for _ in range(120)], []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 12)):
            w[at] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want, largest = banded_classes(df, nd.inverse_frequencies(df.select("text")), 2, 2)
    monkeypatch.setattr(nd, "SIDE", 1000)
    for hot in (1, 1000):
        monkeypatch.setattr(session, "HOT_KEYS", hot)
        assert {r.doc_id: r.class_id for r in nd.near_duplicates(df, bands=2, rows=2).collect()} == want
    assert largest > 20 and len(set(want.values())) > 5


def test_a_block_against_all_pairs():
    rng = np.random.default_rng(6)
    grams = np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
    texts = []
    for _ in range(80):
        keep = rng.random(60) < rng.choice([0.8, 0.9, 1.0])
        texts.append((grams[keep], rng.uniform(1, 1.1, keep.sum())))
    texts += [(np.empty(0, np.uint64), np.empty(0)), texts[0]]
    block = nd.Block(np.arange(len(texts)), texts)
    for i, own in enumerate(texts):
        for least in (0.5, 0.8, 0.95):
            want = [j for j, t in enumerate(texts) if j != i and len(own[0]) and nd.weighted_jaccard(own, t) >= least]
            assert block.alike(i, own, np.arange(len(texts)) != i, least).tolist() == want


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(14)
    vocab = vocabulary(rng, 3000)
    long = [rng.choice(vocab) for _ in range(150_000)]
    docs = [(1, " ".join(long), 5, True), (2, " ".join(long[1:]), 6, False), (3, " ".join(long[:75_000]), 7, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, class_id int, is_kept boolean")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted((r.doc_id, r.class_id) for r in nd.keep_one_each(df).collect()) == [(1, 5), (3, 7)]


def test_copy_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x y z"), (2, "A b c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.is_kept) for r in nd.near_duplicates(df).collect()))
    assert got[0] == (0, 0, True) and [g[:2] for g in got[1:3]] == [(1, 1)] * 2
    kept = nd.keep_one_each(df.withColumn("kept", df["doc_id"]).withColumn("no", df["doc_id"])).collect()
    assert sorted(r.doc_id or 0 for r in kept).count(1) == 1 and any(r.doc_id is None for r in kept)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_query_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op8_near_dedup(spark, SF).collect()}
    want = brute_classes(docs, nd.inverse_frequencies(spark.read.parquet(f"{SF}/documents.parquet").select("text")))
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 50])
def test_pieces_join(size):
    text = "ab cd  efg\nh" * 5
    assert "".join(pieces(text, size)) == text
