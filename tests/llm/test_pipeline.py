"""Each stage against its operator's decisions, and the packed ids against the documents that went in."""

import corpus_pipeline
from foliospark.llm import decontamination, mixing, near_dedup, quality
from foliospark.llm import token_packing as tp

from .test_packing_and_mixing import unpacked

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[:-1])
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept[:-1]]
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = sorted(r.doc_id for r in quality.classify(first, labels).filter("predicted = 1").collect())
    assert ids[0] == good
    assert ids[1] == sorted({r.class_id for r in near_dedup.near_duplicates(kept[0]).collect()})
    leaks = {r.doc_id for r in decontamination.find_leaks(kept[1], bench).collect()}
    assert ids[2] == [d for d in ids[1] if d not in leaks]
    assert ids[3] == sorted(r.doc_id for r in mixing.mix_sources(kept[2]).collect())
    text = {r.doc_id: r.text for r in kept[2].collect()}
    tok = tp.tokenizer(open(tp.VOCAB_PATH, "rb").read())
    want = {d: [*tok.encode(text[d]).tolist(), tok.eos] for d in set(ids[3])}
    rows = kept[-1].collect()
    assert unpacked(rows) == want
    assert sum(r.n_tokens for r in rows) == sum(len(want[d]) for d in ids[3])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "matrix_id" and out.count() > 0


def test_stages_against_brute_force(spark, tmp_path):
    """The chain over the small table, with each decision after the classifier's made anew: all pairs for copies, alignments of whole documents for leaks, quantiles by hand for the mix, the reference tokenizer for the ids."""
    import hashlib

    from foliospark.llm import common

    from .test_leaks_and_copies import brute_classes
    from .test_packing_and_mixing import brute_poisson, reference_ids

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).filter("score >= 0.3").collect()}
    assert 0 < len(good) < len(rows)
    left = docs.filter(docs["doc_id"].isin(*good))
    classes = brute_classes([(d, rows[d].text) for d in sorted(good)], near_dedup.inverse_frequencies(left.select("text")))
    kept = sorted(set(classes.values()))
    hashes = common.WordHashes()
    items = [hashes.of(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d in kept if any(decontamination.smith_waterman(x, hashes.of(rows[d].text or "")) >= decontamination.MIN_SCORE * decontamination.MATCH * len(x) for x in items)}
    clean = [d for d in kept if d not in leaks]
    assert leaks
    sources = {rows[d].source or "" for d in clean}
    of = {s: sum((rows[d].source or "") == s for d in clean) for s in sources}
    copies = {d: brute_poisson(int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / (1 << 52), len(clean) / len(sources) / of[rows[d].source or ""]) for d in clean}
    want = reference_ids([(d, rows[d].text) for d in clean if copies[d]])
    got = corpus_pipeline.run(spark, SF).collect()
    assert unpacked(got) == want
    assert sum(r.n_tokens for r in got) == sum(copies[d] * len(ids) for d, ids in want.items())


def test_stages_with_nulls_repeats_and_nothing(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "It is a plain sentence of a good document that says something. " * 5
    odd = spark.createDataFrame([(None, None, None, None, None), (None, text, "en", None, 1), (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, "", None, "b", 0), (3, text + "And more.", None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        got = stage(spark, odd, SF)
        assert got.count() >= 1, name
        if name != "token_packing":
            assert got.columns == corpus_pipeline.COLUMNS and got.filter("doc_id is null").count() <= 2 * (10 if name == "source_mixing" else 1)
