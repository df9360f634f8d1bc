"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Only ids, digests and signatures are shuffled for all documents; texts move only for documents that
share a band with another text. Exact copies are one text from the start. Groups meet through their
most central member, found by partial aggregates, so no task ever holds a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, join_counted, materialise, ngram_hashes, unused

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Document frequencies of words are kept in so many counters, picked by hash: the same number at every size. Words that share one only look more frequent.
DF_BITS = 18
_TABLE = 1 << 12
#: Members of a group that are verified against one text in one run.
BLOCK = 256
#: Buckets of at most so many texts are compared pair by pair (3.5 pairs a text at most); larger ones with their most central text first, then all their texts that aren't in one class.
SMALL = 8
#: Shingles of the texts of a large bucket on either side of one block of comparisons.
SIDE = 1 << 20


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) of weighted shingles.

    For sample k and shingle s: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln(weight) / r + b);
    ln a = ln c - r (t - b + 1); the sample is the (s, t) of the least a. The three variables of s are
    looked up by three parts of its hash in tables made from a fixed seed; the least ln a itself stands
    for (s, t) in the signature.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(20240607)
        self.r = rng.gamma(2, 1, (samples, _TABLE)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (samples, _TABLE))).astype(np.float32)
        self.b = rng.random((samples, _TABLE), np.float32)

    def signature(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(len(self.r), np.inf, np.float32)
        for at in range(0, len(shingles), 4096):
            h, log_w = shingles[at : at + 4096], np.log(weights[at : at + 4096]).astype(np.float32)
            i, j, k = ((h >> np.uint64(s) & np.uint64(_TABLE - 1)).astype(np.intp) for s in (0, 12, 24))
            r, b = self.r.take(i, 1), self.b.take(j, 1)
            t = log_w / r
            t += b
            np.floor(t, t)
            t -= b
            t += 1
            t *= r
            np.subtract(self.log_c.take(k, 1), t, t)
            np.minimum(best, t.min(1), best)
        return best


def weighted_shingles(hashes: np.ndarray, idf: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of a text and their weights: occurrences times the mean inverse document frequency of the shingle's words. A text of fewer than n words is one shingle."""
    grams = ngram_hashes(hashes, n)
    if not len(grams):
        return grams, np.empty(0)
    n = min(n, len(hashes))
    sums = np.concatenate([[0.0], np.cumsum(idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.intp)])])
    means = (sums[n:] - sums[:-n]) / n
    order = np.argsort(grams, kind="stable")
    grams, means = grams[order], means[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(first, len(grams)))
    return grams[first], means[first] * counts


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater ones; 1 for two empty texts."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (total - low))


def digest(hashes: np.ndarray) -> bytes:
    """128 bits for the word hashes of a text, in order."""
    return hashlib.blake2b(np.ascontiguousarray(hashes), digest_size=16).digest()


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of each counter from texts(text): 1 + ln((1 + N) / (1 + documents with one of its words)), over all rows. The table that comes to the driver has 2**DF_BITS rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total, n = WordHashes(), np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                slots = (cache.of(text.as_py() or "") >> np.uint64(64 - DF_BITS)).astype(np.int64)
                total[np.unique(slots)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["slot", "df"])

    df, n = np.zeros(1 << DF_BITS), 0
    got = texts.mapInArrow(count, "slot bigint, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()
    for slot, value in zip(got["slot"].to_numpy(), got["df"].to_numpy(), strict=True):
        if slot < 0:
            n = value
        else:
            df[slot] = value
    return 1 + np.log((1 + n) / (1 + df))


def signatures(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """doc_id, digest, size (shingles) and the hash of each band (band_0, band_1, ...), for every row of docs(doc_id, text)."""
    names = [f"band_{no}" for no in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sampler, seen = WordHashes(), Sampler(bands * rows), {}
        factor = np.random.default_rng(7).integers(1, 1 << 62, (bands, rows), np.int64).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            digests, size, bucket = [], np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, bands), np.uint64)
            for at, text in enumerate(batch.column(1)):
                hashes = cache.of(text.as_py() or "")
                key = digest(hashes)
                got = seen.get(key)
                if got is None:
                    shingles = weighted_shingles(hashes, idf.value)
                    part = (sampler.signature(*shingles).view(np.uint32).astype(np.uint64).reshape(bands, rows) + np.uint64(1)) * factor
                    part ^= part >> np.uint64(29)
                    got = len(shingles[0]), (part * np.uint64(0xD6E8FEB86659FD93)).sum(1, dtype=np.uint64)
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen[key] = got
                digests.append(key)
                size[at], bucket[at] = got
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(size), *(pa.array(x) for x in np.ascontiguousarray(bucket.T).view(np.int64))], ["doc_id", "digest", "size", *names])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, size bigint, " + ", ".join(f"{x} bigint" for x in names))


def compared(groups: DataFrame, small: int) -> DataFrame:
    """Pairs (node, head) to verify from groups(node, bucket, members): all of a bucket of at most `small` texts; of a larger one, each with the text whose buckets have most members together (ties: the smallest), which is the one that most others are copies of."""
    few = groups.filter(F.col("members") <= small).select("bucket", "node")
    pairs = few.join(few.withColumnRenamed("node", "head"), "bucket").filter("head < node").select("node", "head")
    large = groups.filter(F.col("members") > small)
    central = groups.groupBy("node").agg(F.sum("members").alias("met"))
    first = F.min(F.struct(-F.col("met"), "node"))["node"].alias("head")
    heads = materialise(large.join(central, "node").groupBy("bucket").agg(first, F.count(F.lit(1)).alias("texts")), "heads")
    star = join_counted(large.select("node", "bucket"), heads, "bucket", "texts").filter("node <> head").select("node", "head")
    return star.unionByName(pairs).distinct()


def divided(groups: DataFrame, labels: DataFrame, small: int, side: int) -> DataFrame:
    """The texts of the buckets of more than `small` texts that aren't all of one class, dealt to blocks (bucket, i, j): all texts of the bucket in parts j (asks false), against those outside its largest class in parts i (asks true). A part has about `side` shingles."""
    at = groups.filter(F.col("members") > small).join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label"))
    at = materialise(at, "classes")
    sizes = at.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("texts"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    dealt = lambda size: F.greatest(F.lit(1), F.ceil(size / side)).cast("int")
    parts = materialise(tops.select("bucket", "texts", F.col("top.label").alias("most"), dealt(F.col("size") - F.col("top.size")).alias("rows"), dealt(F.col("size")).alias("cols")), "parts")
    rows = join_counted(at.select("bucket", "node", "label"), parts, "bucket", "texts")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    everyone = rows.select("bucket", each("rows").alias("i"), part("cols").alias("j"), "node", "label", F.lit(False).alias("asks"))
    asking = rows.filter("label <> most").select("bucket", part("rows").alias("i"), each("cols").alias("j"), "node", "label", F.lit(True).alias("asks"))
    return everyone.unionByName(asking)


class Block:
    """The texts of one block with their shingles by value, for exact comparisons of an asking text with all of them."""

    def __init__(self, nodes: np.ndarray, shingles: list[tuple[np.ndarray, np.ndarray]]):
        self.nodes, self.shingles = nodes, shingles
        grams = np.concatenate([g for g, _ in shingles])
        order = np.argsort(grams, kind="stable")
        self.owner = np.repeat(np.arange(len(shingles)), [len(g) for g, _ in shingles])[order]
        self.weight = np.concatenate([w for _, w in shingles])[order]
        self.grams, self.start, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.total = np.array([w.sum() for _, w in shingles])

    def alike(self, node: int, mine: tuple[np.ndarray, np.ndarray], open_: np.ndarray, least: float) -> np.ndarray:
        """Places of the texts, among those that are open, of weighted Jaccard similarity >= least to `mine`.

        What the text shares with any one other is at most the weight of its shingles that others have at
        all, and at most the other's weight; only texts that could reach the similarity by that are measured.
        """
        grams, weights = mine
        if not len(grams) or not len(self.grams):
            return np.empty(0, np.intp)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        others = np.where(self.grams[at] == grams, self.count[at], 0)
        for own in np.flatnonzero(self.nodes == node):
            others -= np.isin(grams, self.shingles[own][0], assume_unique=True)
        held, total = weights[others > 0].sum(), weights.sum()
        most = np.minimum(held, self.total)
        open_ = open_ & (most >= (least - 1e-9) * (total + self.total - most))
        if not open_.any():
            return np.empty(0, np.intp)
        start, count = self.start[at[others > 0]], self.count[at[others > 0]]
        place = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(self.owner[place], np.minimum(self.weight[place], np.repeat(weights[others > 0], count)), len(self.nodes))
        near = np.flatnonzero(open_ & (shared >= (least - 1e-9) * (total + self.total - shared)))
        return np.array([x for x in near if weighted_jaccard(mine, self.shingles[x]) >= least], np.intp)


def crossing(blocks: DataFrame, texts: DataFrame, idf, min_similarity: float) -> DataFrame:
    """Links (node, head, score) between texts of different classes from divided(): every asking text is compared with all texts of its block, exactly. Links within what others of the block have joined are left out, so a block gives less links than it has classes."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("node", "ascending")])
        cache, asks = WordHashes(), block["asks"].to_numpy(zero_copy_only=False).astype(bool)
        node, label = block["node"].to_numpy().copy(), block["label"].to_numpy().copy()
        shingles: list = [None] * len(node)
        for at, text in enumerate(block["text"]):
            same = at and node[at] == node[at - 1] and text == block["text"][at - 1]
            shingles[at] = shingles[at - 1] if same else weighted_shingles(cache.of(text.as_py() or ""), idf.value)
        out, theirs = [], np.flatnonzero(~asks)
        if len(theirs):
            known = Block(node[theirs], [shingles[x] for x in theirs])
            for q in np.flatnonzero(asks):
                for x in known.alike(node[q], shingles[q], label[theirs] != label[q], min_similarity):
                    if label[theirs[x]] != label[q]:
                        out.append((max(node[q], node[theirs[x]]), min(node[q], node[theirs[x]]), min_similarity))
                        label[label == label[theirs[x]]] = label[q]
        return pa.table({"node": pa.array([x[0] for x in out], pa.int64()), "head": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return blocks.hint("merge").join(texts, "node").select("bucket", "i", "j", "node", "label", "asks", "text").groupBy("bucket", "i", "j").applyInArrow(run, "node bigint, head bigint, score double")


def verified(pairs: DataFrame, texts: DataFrame, idf, min_similarity: float) -> DataFrame:
    """pairs(node, head) with their weighted Jaccard similarity, of those that reach min_similarity.

    The members of one head are dealt to blocks by hash; each block gets the head's text once, ahead of
    its members, so a text with any number of partners fills no task.
    """
    heads = materialise(pairs.groupBy("head").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "heads")
    placed = join_counted(pairs, heads, "head", "members").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.select("head", "block", "node").unionByName(heads.select("head", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), F.col("head").alias("node")))
    rows = wanted.hint("merge").join(texts, "node").select("head", "block", "node", "text")
    rows = rows.repartition("head", "block").sortWithinPartitions("head", "block", F.col("node") != F.col("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, of, ours = WordHashes(), None, None
        for batch in batches:
            out: list = []
            for head, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if node == head:
                    of, ours = head, weighted_shingles(cache.of(text.as_py() or ""), idf.value)
                elif of == head:
                    score = weighted_jaccard(ours, weighted_shingles(cache.of(text.as_py() or ""), idf.value))
                    if score >= min_similarity:
                        out.append((node, head, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["node", "head", "score"])

    return rows.select("head", "node", "text").mapInArrow(run, "node bigint, head bigint, score double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the connected component, for every end of edges(node, head). Labels move along edges and jump to their labels' labels, each round a table in the shared folder; rounds go on until none changes."""
    both = materialise(edges.select("node", "head").union(edges.select("head", "node")).distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("head")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "head"), "head").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = materialise(step.join(jump, "new").select("node", F.least("new", "far").alias("label"), "old"), "labels")
        changed = not after.filter("label <> old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    small: int = SMALL,
) -> DataFrame:
    """doc_id, class_id and is_kept for every row of docs(doc_id, text, ...).

    class_id is the smallest doc_id of the class: texts equal in their lower-case words are one, and
    texts of weighted Jaccard similarity >= min_similarity over TF-IDF weighted five-word shingles are
    linked. Classes are the connected components of those links. is_kept: doc_id = class_id.

    Texts meet in the buckets of their bands. A small bucket is compared pair by pair. In a large one
    every text is compared with the most central; then the texts outside its largest class are compared
    with all its texts, in blocks of bounded size and exactly, so the classes are those of all pairs of
    all buckets. No bucket is capped, and nothing but the similarity itself drops a pair that meets.

    Null text counts as empty; all texts without a word are one class. Rows with a null doc_id come back
    with null class_id and is_kept true. Rows that repeat a doc_id come back each; if their texts differ,
    the document joins the classes of both. Ties don't arise (smallest id). Empty table: no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(plain.select("text")))
    signed = materialise(signatures(plain, idf, bands, rows), "signed")
    known = signed.filter("doc_id is not null")
    names = [f"band_{no}" for no in range(bands)]
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), *(F.max(x).alias(x) for x in names))
    nodes = materialise(nodes, "nodes")
    start = nodes.select("node", "size", F.posexplode(F.array(*names)).alias("band_no", "band")).select("node", "size", F.xxhash64("band_no", "band").alias("bucket"))
    shared = materialise(start.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    groups = materialise(join_counted(start, shared, "bucket", "members"), "groups")
    at = join_counted(known.select("doc_id", "digest"), nodes.select("digest", "node", "copies"), "digest", "copies").select("doc_id", "node")
    if groups.isEmpty():
        at = at.withColumn("label", F.lit(None).cast("bigint"))
    else:
        # sort-merge joins at every size: what has to move on a cluster moves here too
        texts = materialise(plain.withColumnRenamed("doc_id", "node").join(groups.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")
        edges = materialise(verified(materialise(compared(groups, small), "pairs"), texts, idf, min_similarity), "links")
        labels = components(edges)
        further = materialise(crossing(divided(groups, labels, small, SIDE), texts, idf, min_similarity), "links")
        if not further.isEmpty():
            labels = components(edges.unionByName(further))
        at = at.join(labels, "node", "left")
    out = at.select("doc_id", F.coalesce("label", "node").alias("class_id")).withColumn("is_kept", F.col("doc_id") == F.col("class_id"))
    rest = signed.filter("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("is_kept"))
    return out.unionByName(rest)


def keep_one_each(docs: DataFrame, **how) -> DataFrame:
    """One row of docs of each class of near_duplicates, with all its columns, and every row with a null doc_id. Of repeated rows of the kept doc_id one stays (the first by text)."""
    key, no = unused(docs, "kept"), unused(docs, "no")
    kept = near_duplicates(docs, **how).filter("is_kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    own = docs.filter(docs["doc_id"].isNotNull())
    own = own.join(kept, own["doc_id"].cast("bigint") == F.col(key), "left_semi")
    own = own.withColumn(no, F.row_number().over(Window.partitionBy(own["doc_id"]).orderBy(own["text"]))).filter(F.col(no) == 1).drop(no)
    return own.unionByName(docs.filter(docs["doc_id"].isNull()))
