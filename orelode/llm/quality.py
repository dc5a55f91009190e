"""Quality by ordinal cumulative-link regression on graded ratings.

A text becomes counts of hashed words, of hashed word shapes and of words that
repeat the one before; the features are the square roots of their shares. One
weight vector is shared by all grades; ordered thresholds cut its score:
``P(grade >= k) = sigmoid(w.x - b_k)`` with ``b_1 <= b_2 <= ...``. The expected
grade is the sum of these tail probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import frugal, id_text, left_behind, set_aside, strings

DIM = 1 << 14
REPEAT = 0  # the bucket of words that repeat the one before
CACHE = 300_000
_RUNS = [(re.compile(p), r) for p, r in (("[^\\W\\d_]+", "x"), ("[0-9]+", "9"), (r"(.)\1+", r"\1\1"))]


class _Buckets(dict):
    """word -> its bucket + DIM * its shape's bucket, remembered for short words only."""

    def __missing__(self, word: str) -> int:
        shape = "X" if len(word) > 1 and word.isupper() else "Xx" if word[:1].isupper() else "x"
        if not word.isalpha():
            for pattern, put in _RUNS:
                word_shape = pattern.sub(put, word if pattern is _RUNS[0][0] else word_shape)
            shape += word_shape
        both = 1 + zlib.crc32(word.lower().encode()) % (DIM - 1) + DIM * (1 + zlib.crc32(b"shape" + shape[:40].encode()) % (DIM - 1))
        if len(word) <= 40:
            self[word] = both
        return both


_buckets = left_behind(_Buckets(), "quality")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of each bucket; all zero for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(DIM)
    both = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    if len(_buckets) > CACHE:
        _buckets.clear()
    counts = np.bincount(both % DIM, minlength=DIM) + np.bincount(both // DIM, minlength=DIM)
    counts[REPEAT] += int((both[1:] == both[:-1]).sum())
    return np.sqrt(counts / len(words))


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features other than zero."""
    x = features(text)
    cols = np.flatnonzero(x)
    return cols.astype(np.int32), x[cols].astype(np.float32)


@dataclass(frozen=True)
class Ordinal:
    """A fitted model: grades ``0 .. len(thresholds)``."""

    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, of one feature row or many."""
        z = np.asarray(x @ self.weights)[..., None] - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class _Rated:
    """Sparse rows and their grades; each grade weighs the same in sum, whatever its share."""

    cols: np.ndarray
    vals: np.ndarray
    row: np.ndarray
    grades: np.ndarray
    weight: np.ndarray


def _rated(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> _Rated:
    grades = np.array([r[2] for r in rows], np.int64)
    share = np.bincount(grades)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    return _Rated(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), row, grades, 1 / (share[grades] * (share > 0).sum()))


def _thresholds(base: float, gaps: np.ndarray) -> np.ndarray:
    """A base plus the running sum of positive gaps, so they stay in order."""
    return base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _likelihood(data: _Rated, w: np.ndarray, base: float, gaps: np.ndarray, shrink: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """The shrunk negative log-likelihood and its gradient by weights, base and gaps."""
    grades, top = data.grades, len(gaps) + 1
    z = np.bincount(data.row, weights=data.vals * w[data.cols], minlength=len(grades))
    cut = np.concatenate([[-np.inf], _thresholds(base, gaps), [np.inf]])
    hi, lo = 1 / (1 + np.exp(-np.clip(z - cut[grades], -40, 40))), 1 / (1 + np.exp(-np.clip(z - cut[grades + 1], -40, 40)))
    hi, lo = np.where(grades == 0, 1.0, hi), np.where(grades == top, 0.0, lo)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = data.weight * hi * (1 - hi) / p, data.weight * lo * (1 - lo) / p  # of log p by the two cuts
    gb = np.bincount(grades[grades > 0] - 1, weights=dhi[grades > 0], minlength=top) - np.bincount(grades[grades < top], weights=dlo[grades < top], minlength=top)
    gw = np.bincount(data.cols, weights=data.vals * (dlo - dhi)[data.row], minlength=len(w)) + shrink * w
    loss = -float((data.weight * np.log(p)).sum()) + shrink / 2 * float(w @ w)
    return loss, gw, float(gb.sum()), np.cumsum(gb[::-1])[::-1][1:] * np.exp(gaps)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.3, shrink: float = 1e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model, by Adam on all rows (buckets, values, grade).

    With no rows, or a single grade, the model has the one tail probability
    1/2 for everything.
    """
    grades = [r[2] for r in rows]
    top = max(grades, default=0)
    if len(set(grades)) < 2:
        return Ordinal(np.zeros(DIM), np.zeros(max(1, top)))
    data = _rated(rows)
    w, base, gaps = np.zeros(DIM), -1.0, np.zeros(top - 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, np.zeros(1), gaps)]
    for step in range(1, steps + 1):
        _, gw, gb, gg = _likelihood(data, w, base, gaps, shrink)
        moved = []
        for (m, v), g in zip(state, (gw, np.array([gb]), gg), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moved.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        w, base, gaps = w - moved[0], base - float(moved[1][0]), gaps - moved[2]
    return Ordinal(w, _thresholds(base, gaps))


def rated_sample(docs: DataFrame, ratings: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most ``most`` rated documents, gathered on the driver.

    ``ratings`` has ``doc_id, grade`` (0, 1, ...; nulls are left out). Each
    grade gives the same number at most, chosen by the hash of its id, so the
    sample is the same whatever the partitioning. Features are computed on the
    executors from whole texts and arrive as at most ``DIM`` numbers a row.
    """
    graded = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    grades = sorted(r[0] for r in graded.select("grade").distinct().limit(100).collect())
    chosen = None
    for g in grades:
        part = graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, most // len(grades)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                found = [sparse(t) for t in strings(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["grade", "cols", "vals"])

    got = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(frugal(rows, "quality"), "grade int, cols binary, vals binary").collect()
    return [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32), g) for g, c, v in sorted((r["grade"], bytes(r["cols"]), bytes(r["vals"])) for r in got)]


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Expected grade and tail probabilities of whole texts.

    Returns ``doc_id, expected_grade, tails array<double>`` (tails[k - 1] is
    P(grade >= k)), a row for each input row; with ``keep`` these two columns
    are added to all input columns instead, or replace those so named. Null and empty texts score as a
    text without words. There is no shuffle; the model is broadcast, its size
    is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[np.ndarray]:
        return [shared.value.tails(features(t)) for t in texts]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(batch.schema.names)
            tails = run(strings(batch.column(names.index(text_col if keep else "text"))))
            kept = list(batch.columns) if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))], names=[*(names if keep else names[:1]), "expected_grade", "tails"])

    if keep:
        rest, names = set_aside(docs.drop("expected_grade", "tails"), id_col, text_col)
        return rest.mapInArrow(frugal(rows, "quality"), StructType([*rest.schema.fields, StructField("expected_grade", DoubleType()), StructField("tails", ArrayType(DoubleType()))])).withColumnsRenamed(names)
    return id_text(docs, id_col, text_col).mapInArrow(frugal(rows, "quality"), "doc_id long, expected_grade double, tails array<double>")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the label table: 0 poor, 1 good text with toxic passages, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("grade"))
