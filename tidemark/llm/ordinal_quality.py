"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's hashed features share one weight vector over all grades; ordered
thresholds turn its score into P(grade > k) = sigmoid(score - threshold k).  The
expected grade ranks texts, the tail probability of the grade wanted selects
them.

The fit uses a bounded, documented sample of the labelled rows (``SAMPLE``, by
hash of doc_id, with all grades); only its hashed features come to the driver.
Scoring reads every document and whole texts, one row at a time, without any
shuffle.

Defined results: null and empty texts have no features and get the score of the
bias alone, and are not selected; documents without labels are scored like any
other; labels with a null count as missing; doc_ids labelled more than once count
once, with the lowest grade; without labelled rows of two grades all but empty
texts are selected; a text of any length is read whole, one at a time; other columns
can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, text_of

BUCKETS = 1 << 18
#: Most rows for the fit: so many labels are taken, and so many rows if doc_ids repeat in the documents.
SAMPLE = 12_000
#: So many that the penalty has dropped the words that say little (12,000 rows: 2,097 weights after 300 steps, 261 after 900).
STEPS = 900
RATE = 0.5
#: Penalty on the sum of absolute weights, times the root of the sample's size:
#: words that say little get exactly none.
PENALTY = 0.05
#: Buckets that fewer of the sample's rows have get no weight; a number and no share,
#: so that more labels bring rarer words in.
LEAST_ROWS = 5
#: A text is selected if the probability of at least this grade reaches the limit.
GRADE = 2
#: Bytes of the beginning that longer words are known by besides the whole word.
STEM = 4
LIMIT = 0.35
_WORD_BYTES = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())
_TO_WORDS = bytes(b if b in _WORD_BYTES else 32 for b in bytes(range(256)).lower())


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: bad; 1: good but toxic; 2: good and clean; null: not rated."""
    return F.when(quality == 0, 0).when(quality.isNotNull() & (toxic == 1), 1).when(quality.isNotNull() & toxic.isNotNull(), 2)


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of a text's words, of their beginnings, of the marks around its words, and of its share of repeats."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_TO_WORDS).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    distinct = set(words)
    found = set(map(zlib.crc32, distinct))
    # rare inflections of a stem count together
    found.update(map(zlib.crc32, {b"\x03" + w[:STEM] for w in distinct if len(w) > STEM}))
    for mark, n in Counter(raw.translate(None, _WORD_BYTES).split()).items():
        # a mark counts by the power of two of its share of all words
        found.add(zlib.crc32(b"\x01%b\x01%d" % (mark, max(-8, int(math.log2(n / len(words)))))))
    repeats = sum(map(eq, words, words[1:]))
    for name, share in ((b"rep", repeats / len(words)), (b"dist", len(distinct) / len(words)), (b"len", min(1.0, len(words) / 50))):
        found.add(zlib.crc32(b"\x02%b%d" % (name, int(share * 8))))
    return np.unique(np.fromiter(found, dtype=np.int64, count=len(found)) % BUCKETS)


@dataclass(frozen=True)
class Ordinal:
    """weights: per bucket; thresholds: ordered, one fewer than the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) and so on."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Ordinal:
    """Maximum likelihood of the cumulative-link model by adaptive gradient steps.

    Thresholds are a first one and log-gaps, so they stay ordered.  Grades are
    weighed inversely to the square root of their frequency.
    """
    cols = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    n = max(1, len(rows))
    common = np.bincount(cols, minlength=buckets) >= min(n / 4, LEAST_ROWS)
    owner, cols = owner[common[cols]], cols[common[cols]]
    used, cols = np.unique(cols, return_inverse=True)
    cols = cols.astype(np.int32)
    # entries lie by row; sorted by bucket, sums over either are sums over neighbours
    by_row, by_bucket = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (owner, np.sort(cols)))
    filled, sorted_owner = owner[by_row], owner[np.argsort(cols, kind="stable")]
    share = np.bincount(grades, minlength=n_grades) / n
    weigh = 1 / np.sqrt(np.maximum(share, 1 / n))[grades]
    weigh /= weigh.mean() if len(weigh) else 1
    w, first, gaps = np.zeros(len(used)), -1.0, np.zeros(n_grades - 2)
    sums = [np.full(len(used), 1e-8), 1e-8, np.full(n_grades - 2, 1e-8)]
    penalty = max(1e-3, penalty / math.sqrt(n))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for _ in range(steps):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.zeros(len(rows))
        score[filled] = np.add.reduceat(w[cols], by_row) if len(cols) else 0.0
        upper = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = upper[grades], upper[grades + 1]
        a, b = sigmoid(high - score), sigmoid(low - score)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        g_score = weigh * (da - db) / p / n
        g_t = np.zeros(n_grades - 1)
        np.add.at(g_t, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -weigh * da / p / n, 0))
        np.add.at(g_t, np.maximum(grades - 1, 0), np.where(grades > 0, weigh * db / p / n, 0))
        g_w = np.add.reduceat(g_score[sorted_owner], by_bucket) if len(cols) else np.zeros(0)
        steps_by = [g_w, g_t.sum(), np.cumsum(g_t[::-1])[::-1][1:] * np.exp(gaps)]
        for s, g in zip((0, 1, 2), steps_by):
            sums[s] = sums[s] + np.square(g)
        pace = rate / np.sqrt(sums[0])
        w = w - pace * steps_by[0]
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        first = first - rate * steps_by[1] / np.sqrt(sums[1])
        gaps = gaps - rate * steps_by[2] / np.sqrt(sums[2])
    weights = np.zeros(buckets)
    weights[used] = w
    return Ordinal(weights.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal | None:
    """Fit on at most ``sample`` labelled rows; None if they have fewer than two grades."""
    graded = labels.select(F.col(id_col).alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).dropna()
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = cut_lineage(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()).astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["place", "grade", "found"])

    # a doc_id may stand in several rows, so the rows are bounded too; ``chosen`` has at most ``sample`` rows, so it is broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    placed = rows.select(F.xxhash64("doc_id", "text").alias("place"), "grade", "text")
    sampled = placed.mapInArrow(run, "place long, grade int, found array<int>").orderBy("place", "grade").limit(sample)
    got = sampled.toArrow().sort_by([("place", "ascending"), ("grade", "ascending")])
    grades = got.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return None
    found = [np.array(f.as_py(), dtype=np.int32) if len(f) else np.zeros(0, dtype=np.int32) for f in got.column("found")]
    return fit(found, grades, 3)


def _tails(model: Ordinal | None, found: np.ndarray, grade: int) -> np.ndarray:
    return model.tails(model.score(found)) if model else np.ones(grade)


def _kept(found: np.ndarray, tails: np.ndarray, grade: int, limit: float) -> bool:
    return len(found) > 0 and bool(tails[grade - 1] >= limit)


def score(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", grade: int = GRADE, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability (of ``grade`` or more), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            tails = [_tails(model, f, grade) for f in found]
            columns = [
                pa.array([float(t.sum()) for t in tails], pa.float64()),
                pa.array([float(t[grade - 1]) for t in tails], pa.float64()),
                pa.array([_kept(f, t, grade, limit) for f, t in zip(found, tails)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Ordinal | None, text_col: str = "text", grade: int = GRADE, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that are selected, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(at)]
            yield batch.filter(pa.array([_kept(f, _tails(model, f, grade), grade, limit) for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
