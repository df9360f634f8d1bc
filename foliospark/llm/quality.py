"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, held_out, pieces, unused

#: Labelled rows that a model is fitted on at most: those of the least hash of doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 100, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.3

_MARKS = b"!|$%&*#.,;:?<>{}[]()/\\@=_-+\"'"
FEATURES = [
    "log_chars", "log_words", "log_lines", "word_chars", "line_words", "unique_words", "unique_lines", "repeated_next", "long_words",
    "lower", "upper", "digit", "space", "high", "control", "entropy", "line_ends", *(f"mark_{chr(c)}" for c in _MARKS),
]


def statistics(text: str | None, size: int = CHUNK_CHARS) -> np.ndarray:
    """The statistics of a whole text; zeros for an empty one. Long texts are counted in pieces of `size` characters or more; the last word and the open line of a piece go on into the next, so the pieces change nothing."""
    text = text or ""
    counts = np.zeros(256, np.int64)
    n_words = repeats = lines = ended = 0
    seen: set[int] = set()
    long: set[int] = set()
    seen_lines: set[int] = set()
    last, line = None, [""]

    def close(rows: list[str]) -> tuple[int, int]:
        rows = [r for r in map(str.strip, rows) if r]
        seen_lines.update(map(hash, rows))
        return len(rows), sum(r[-1] in ".!?:;\"'" for r in rows)

    for piece in pieces(text, size):
        counts += np.bincount(np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        found = piece.split()
        n_words += len(found)
        repeats += sum(map(eq, found, found[1:])) + (bool(found) and found[0] == last)
        last = found[-1] if found else last
        seen.update(map(hash, set(found)))
        long.update(hash(w) for w in set(found) if len(w) > 25)
        rows = piece.split("\n")
        if len(rows) > 1:
            n, e = close(["".join([*line, rows[0]]), *rows[1:-1]])
            lines, ended, line = lines + n, ended + e, []
        line.append(rows[-1])
    n, e = close(["".join(line)])
    lines, ended = lines + n, ended + e
    total = int(counts.sum())
    if not total:
        return np.zeros(len(FEATURES), np.float32)
    share = counts / total
    some = share[share > 0]
    return np.array(
        [
            np.log1p(len(text)), np.log1p(n_words), np.log1p(lines), (total - counts[32] - counts[9:14].sum()) / max(1, n_words), n_words / max(1, lines), len(seen) / max(1, n_words), len(seen_lines) / max(1, lines), repeats / max(1, n_words), len(long) / max(1, n_words),
            share[97:123].sum(), share[65:91].sum(), share[48:58].sum(), share[32] + share[9:14].sum(), share[128:].sum(), share[:9].sum() + share[14:32].sum(), -(some * np.log(some)).sum(), ended / max(1, lines), *share[list(_MARKS)],
        ],
        np.float32,
    )


@dataclass
class Trees:
    """Complete binary trees: node i has the children 2i + 1 (value <= threshold) and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x, all rows and trees at once, a step for each level."""
        margin = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.feature)), np.intp)
            for _ in range(int(np.log2(self.feature.shape[1] + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            margin += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1 under log loss: features are cut into quantile bins once, and a level of a tree takes its splits from gradient histograms over (node, feature, bin). No rows: 0.5 for all."""
    inner = (1 << depth) - 1
    p = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.intp), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)  # bin b: value <= cut b
    place = binned + np.arange(m) * bins
    margin = np.full(n, base)
    out_f, out_t, out_v = np.zeros((trees, inner), np.intp), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for k in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.intp)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (m * bins) + place).ravel()
            shape = (width, m, bins)
            g, h, c = (np.bincount(flat, np.repeat(w, m), width * m * bins).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(n)))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(c < MIN_ROWS) | (ct - c < MIN_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(1)
            feature, cut = best // bins, best % bins
            for i in range(width):
                if gain[i, feature[i], cut[i]] > 1e-6:
                    out_f[k, first + i], out_t[k, first + i] = feature[i], cuts[feature[i]][cut[i]]
            f, t = out_f[k, node], out_t[k, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > t)
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + L2)
        out_v[k] = value
        margin += value[leaf]
    return Trees(base, out_f, out_t, out_v)


def _statistics_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        x = np.zeros((batch.num_rows, len(FEATURES)), np.float32)
        for i, text in enumerate(batch.column(column)):
            x[i] = statistics(text.as_py())
        yield batch, x


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees for labels(doc_id, quality), from the labelled documents whose crc32(doc_id) mod 5 is not 0: at most `rows` labels, by least hash, and 2 * `rows` documents with them. Only the statistics of those come to the driver. Rows with a null id or label are left out."""
    good = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1) & ~held_out(labels["doc_id"]))
    chosen = good.select(good["doc_id"].cast("bigint").alias("doc_id"), good["quality"].cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    joined = own.join(F.broadcast(chosen), "doc_id")  # bounded by `rows`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _statistics_of(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    got = joined.select("doc_id", "text", "quality").mapInArrow(run, "doc_id bigint, quality int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(2 * rows).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """Every row of docs with its columns and, last, its score, in place: nothing is shuffled. The column's name is score, or one with underscores if docs has it."""
    name = unused(docs, "score")
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _statistics_of(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(x))], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from threshold on) for every row of docs(doc_id, text, ...).

    The score comes from the text alone. Null text is empty; empty texts get a score too (that of zeros
    in all statistics). A null doc_id isn't held out. Repeated rows: a row each, of one score. A document
    with both labels is trained on with both. No labels: 0.5 for all. Other columns are ignored.
    """
    plain = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    scored = score_quality(plain, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of a score from threshold on, with their columns."""
    scored = score_quality(docs, train(docs, labels))
    name = scored.columns[-1]
    return scored.filter(F.col(name) >= threshold).drop(name)
