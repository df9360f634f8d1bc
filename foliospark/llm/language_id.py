"""Language ID: blended-spectrum string kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: Rows that a model is fitted on at most (those of the least hash of the id, besides some of each language), characters of such a row at most, landmarks of a language, ridge.
TRAIN_ROWS, TRAIN_CHARS, LANDMARKS, RIDGE = 3000, 20_000, 48, 1e-2
#: Rows of each language that are drawn in any case, as far as it has so many; languages at most, those of most rows.
EACH_LANGUAGE, LANGUAGES = 16, 1000
#: Landmarks in all; numbers of the matrix that is sent to the executors (n-grams x languages, 4 bytes each); numbers of a batch of presence rows.
MAX_LANDMARKS, CELLS, BATCH_CELLS = 1024, 1 << 24, 1 << 24
#: N-grams go by hash to 2**CODE_BITS codes; two that share one count as the same.
CODE_BITS, _ORDERS = 20, 3
_CODES = 1 << CODE_BITS
# Odd factors for the characters of an n-gram, last first, for n = 1, 2, 3.
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, (_ORDERS, _ORDERS), np.int64).astype(np.uint64) | np.uint64(1)
#: Code points read at a time.
STEP = 1 << 18


def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)), bool, 1 << 16)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """The code points of a text's letters, in lower case; 0 stands for everything else, which tells no language from another."""

    def __init__(self):
        self.table = np.where(_is_letter(), np.arange(1 << 16), 0).astype(np.uint64)

    def numbers(self, points: np.ndarray) -> np.ndarray:
        far = points >= 1 << 16
        if not far.any():
            return self.table[points]
        out = self.table[np.where(far, 0, points)]
        out[far] = [c if unicodedata.category(chr(c))[0] == "L" else 0 for c in points[far]]
        return out


def present(text: str, letters: Letters, slots: np.ndarray, n_slots: int) -> tuple[np.ndarray, bool]:
    """Which slots (of n_slots; slots[code] or n_slots for none) have an n-gram of 1 to 3 characters of the whole text, and whether it has a letter. N-grams without a letter have code 0."""
    out, some = np.zeros(n_slots + 1, bool), False
    for at in range(0, len(text), STEP):
        s = letters.numbers(code_points(text[max(0, at - _ORDERS + 1) : at + STEP]))
        some = some or bool(s.any())
        for n in range(_ORDERS):
            if len(s) > n:
                code = s[n:] * _FACTORS[n, 0]
                for j in range(1, n + 1):
                    code += s[n - j : len(s) - j] * _FACTORS[n, j]
                code ^= code >> np.uint64(32)
                code *= np.uint64(0x9E3779B97F4A7C15)
                out[slots[(code >> np.uint64(64 - CODE_BITS)).astype(np.intp)]] = True
    return out[:n_slots], some


@dataclass
class Model:
    languages: list[str]
    letters: Letters
    slots: np.ndarray  # n-gram code -> row of folded
    n_slots: int
    folded: np.ndarray  # landmarks' normalised presence times weights: slots x languages, CELLS numbers at most

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """Batch of presence rows -> a value for each language: kernel rows against the landmarks, then the ridge weights. K W = (P L) W is taken as P (L W), one matrix product for a batch."""
        p = presence.astype(np.float32)
        size = np.sqrt(np.maximum(1, p.sum(1, keepdims=True)))
        return (p @ self.folded) / size


def slots_of(marks: list[np.ndarray], langs: list[str], cells: int) -> np.ndarray:
    """The codes that are counted: all that a landmark has, or of each language the same number, those that most of its landmarks have, so that codes times languages stay within `cells`. marks: codes of each landmark."""
    every = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    every = every[every > 0]  # 0 has no letter
    names = sorted(set(langs))
    most = max(len(names), cells // max(1, len(names)))
    if len(every) <= most:
        return every
    chosen = []
    for name in names:
        codes, n = np.unique(np.concatenate([m for m, lang in zip(marks, langs, strict=True) if lang == name]), return_counts=True)
        n[codes == 0] = 0
        chosen.append(codes[np.lexsort((codes, -n))][: most // len(names)])
    return np.setdiff1d(np.concatenate(chosen), [0])


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, cells: int = CELLS) -> Model | None:
    """Kernel k(x, y) = |shared n-grams of 1 to 3 characters| / sqrt(|x| |y|), over n-grams that a landmark has, of all letters there are (see slots_of). Landmarks: the first texts of each language, MAX_LANDMARKS in all, or one of each language. Weights: the Nyström form of ridge regression on targets 1 (the language) and -1, (K'K + ridge n Kmm) w = K'y. None without a text.

    Presence rows are made in batches and kept as bits only of landmarks, so memory doesn't grow with
    n-grams times texts: the matrices are texts x landmarks, landmarks x n-grams (in bytes) and n-grams x languages.
    """
    if not texts:
        return None
    languages = sorted(set(langs))
    landmarks = max(1, min(landmarks, MAX_LANDMARKS // len(languages)))
    letters = Letters()
    every = np.arange(_CODES)
    took: Counter[str] = Counter()
    chosen = []
    for i, lang in enumerate(langs):
        if took[lang] < landmarks:
            took[lang] += 1
            chosen.append(i)
    codes = slots_of([np.flatnonzero(present(texts[i], letters, every, _CODES)[0]) for i in chosen], [langs[i] for i in chosen], cells)
    n_slots = len(codes)
    slots = np.full(_CODES, n_slots, np.int32)
    slots[codes] = np.arange(n_slots)
    marks = np.stack([present(texts[i], letters, slots, n_slots)[0] for i in chosen])
    norm = 1 / np.sqrt(np.maximum(1, marks.sum(1, dtype=np.float32)))
    step = max(1, BATCH_CELLS // max(1, n_slots))
    k = np.empty((len(texts), len(chosen)))
    for at in range(0, len(texts), step):
        x = np.stack([present(t, letters, slots, n_slots)[0] for t in texts[at : at + step]]).astype(np.float32)
        x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
        for j in range(0, len(chosen), step):
            k[at : at + step, j : j + step] = x @ (marks[j : j + step].T * norm[j : j + step])
    y = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    kmm = k[chosen]
    weights = np.linalg.solve(k.T @ k + ridge * len(texts) * kmm / len(chosen) + 1e-6 * np.eye(len(chosen)), k.T @ y)
    folded = np.zeros((n_slots, len(languages)), np.float32)
    for j in range(0, len(chosen), step):
        folded += (marks[j : j + step].T * norm[j : j + step]) @ weights[j : j + step].astype(np.float32)
    return Model(languages, letters, slots, n_slots, folded)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """From text and lang of documents whose crc32(doc_id) mod 5 is not 0: at most `rows` of up to 20,000 characters, by least hash, and EACH_LANGUAGE of every language, of LANGUAGES at most (longer texts last, by their first 20,000 characters). So no more rows come to the driver than those numbers allow. Rows without a text, language or id are left out."""
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    own = own.filter(own["lang"].isNotNull() & own["doc_id"].isNotNull() & own["text"].isNotNull() & ~held_out(own["doc_id"]) & (F.length("text") > 0))
    named = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    own = own.join(F.broadcast(named.select("lang")), "lang", "left_semi").withColumn("long", F.length("text") > TRAIN_CHARS)
    short = own.filter(~own["long"])
    ids = short.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows)
    got = short.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(rows).collect()
    first = lambda *ties: F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", *ties))
    some = own.select("doc_id", "lang", "long").withColumn("no", first()).filter(F.col("no") <= EACH_LANGUAGE).select("doc_id", "lang", "long").distinct()
    each = own.join(F.broadcast(some), ["doc_id", "lang", "long"]).withColumn("text", F.substring("text", 1, TRAIN_CHARS)).withColumn("no", first("text")).filter(F.col("no") <= EACH_LANGUAGE).select("doc_id", "lang", "text").collect()
    have = {(r["doc_id"], r["lang"]) for r in got}
    got += sorted((r for r in each if (r["doc_id"], r["lang"]) not in have), key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs(doc_id, text, lang, ...).

    lang_pred comes from the whole text alone: the language of the greatest ridge value (ties: the first
    in order of name), or 'und' with score 0 for null text, text without a letter, or if there is nothing
    to learn from. score: the ridge value moved from [-1, 1] to [0, 1], cut at both ends. A null doc_id
    isn't held out. Repeated rows: a row each. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            langs, values = [], []
            for at in range(0, batch.num_rows, 128):
                texts = [t.as_py() or "" for t in batch.column(1).slice(at, 128)]
                if m is None:
                    langs += ["und"] * len(texts)
                    values += [0.0] * len(texts)
                    continue
                found = [present(t, m.letters, m.slots, m.n_slots) for t in texts]
                scores = m.scores(np.stack([p for p, _ in found]))
                for (_, some), row in zip(found, scores, strict=True):
                    best = int(row.argmax())
                    langs.append(m.languages[best] if some else "und")
                    values.append(float(min(1.0, max(0.0, (row[best] + 1) / 2))) if some else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType().add("doc_id", id_type).add("lang_pred", StringType()).add("score", DoubleType())
    got = docs.select(docs["doc_id"], docs["text"].cast("string")).mapInArrow(run, out)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
