"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x), with one weight vector for all grades and ascending thresholds. x has the
presence of each hashed word of the text and of coarse shapes: what a word has besides letters and digits, by its share
of the words. It gives the expected grade, and the tail probability of a grade or better, by which documents are kept.

The model is fitted on the driver, on at most SAMPLE labelled rows, those with the least hash of the id; everything else
covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rippleframe.llm.common import by_slice

#: Labelled rows for fitting at most: bounds what comes to the driver (about 1 KB a row).
SAMPLE = 12_000
#: Hash bits of features; features in fewer sampled rows than LEAST_ROWS have no weight.
BITS, LEAST_ROWS = 18, 4
STEPS, RATE, DECAY = 120, 0.08, 2e-4
#: Kept: at least this probability of the highest grade.
KEEP_AT = 0.5
_MARKS = re.compile(r"[^\W_]+")
_EDGE = ".,;:!?\"'()[]{}|#*$%&<>-"


def features(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's features."""
    words = text.split()
    total = len(words)
    counts = Counter(words)
    found, shapes = set(), Counter()
    for w, n in counts.items():
        found.add("w" + w.strip(_EDGE).lower())
        if not w.isalpha() or w.isupper():
            shape = _MARKS.sub("a", w)[:8] + "A" * (len(w) > 2 and w.isupper())
            shapes[shape] += n
    for shape, n in shapes.items():
        found.add(f"s{shape}:{int(np.log2(n / total))}")
    if total:
        found.add(f"l{int(np.log2(total))}")
        found.add(f"d{int(10 * len(counts) / total)}:{int(np.log2(total))}")
        found.add(f"m{min(40, int(sum(map(len, words)) / total))}")
    return np.unique(np.array([zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in found], dtype=np.int32))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights by feature, and ascending thresholds: one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> "Ordinal":
        """Maximum likelihood with decay of weights, by Adam over all rows."""
        share = np.array([(grades <= k).mean() if len(grades) else (k + 1) / n_grades for k in range(n_grades - 1)])
        share = np.clip(share, 1e-3, 1 - 1e-3)
        start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
        model = cls(np.zeros(1 << BITS, dtype=np.float32), start)
        if len(grades) == 0 or not sum(map(len, rows)):
            return model
        column = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        kept = np.bincount(column, minlength=1 << BITS) >= LEAST_ROWS
        use, own = kept[column], np.cumsum(kept) - 1
        column, row, m = own[column[use]], row[use], int(kept.sum())
        # The parameters: weights, the first threshold, logarithms of the gaps between thresholds.
        p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        first, second = np.zeros_like(p), np.zeros_like(p)
        at = np.arange(len(rows))
        for step in range(1, STEPS + 1):
            gaps = np.exp(p[m + 1 :])
            theta = np.concatenate([[-np.inf], p[m] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
            z = np.bincount(row, weights=p[column], minlength=len(rows))
            high, low = _logistic(theta[grades + 1] - z), _logistic(theta[grades] - z)
            likely = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / likely, low * (1 - low) / likely
            slope = np.zeros_like(p)
            slope[:m] = np.bincount(column, weights=(d_high - d_low)[row], minlength=m) / len(rows) + DECAY * p[:m]
            d_theta = np.zeros((len(rows), n_grades + 1))
            d_theta[at, grades + 1] -= d_high
            d_theta[at, grades] += d_low
            d_theta = d_theta.mean(axis=0)[1:-1]
            slope[m] = d_theta.sum()
            slope[m + 1 :] = gaps * np.cumsum(d_theta[::-1])[::-1][1:]
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights[kept] = p[:m]
        model.thresholds = p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])
        return model

    def at_most(self, row: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k below the highest."""
        return _logistic(self.thresholds - float(self.weights[row].sum(dtype=np.float64)))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, text: str, id_column: str) -> Ordinal:
    """ratings: id, grade (0 to n_grades - 1; null ones are left out, of several the least counts)."""
    chosen = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x) for x in batch.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["grade", "row"])

    rows = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    rows = rows.join(F.broadcast(chosen.select("id", F.col("grade").cast("int").alias("grade"))), "id").select("body", "grade")
    got = rows.mapInArrow(by_slice(work), "grade int, row array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["grade"], len(r["row"]), r["row"]))  # the order of tasks is not to change the sums
    return Ordinal.fit([np.array(r["row"], dtype=np.int64) for r in got], np.array([r["grade"] for r in got], dtype=np.int64), n_grades)


def classify(spark: SparkSession, docs: DataFrame, ratings: DataFrame, n_grades: int, text: str = "text", id_column: str = "doc_id", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: all its columns in the struct `doc`, expected_grade, tail_probability, kept.

    A null or empty text has no features but is judged as any other. Without ratings every grade is as likely as any
    other, so the tail is 1 / n_grades, and all documents are kept. Null ids and repeated rows are judged row by row.
    Columns of docs cannot clash, as they stay inside the struct. An empty table gives an empty result.
    """
    model = fit(docs, ratings, n_grades, text, id_column)
    unfitted = not model.weights.any()
    shared = spark.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        grade, tail = [], []
        for x in batch.column("body").to_pylist():
            below = shared.value.at_most(features(x))
            grade.append(float(len(below) - below.sum()))
            tail.append(float(1 - below[-1]))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(grade), pa.array(tail)], names=["doc", "expected_grade", "tail_probability"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("body"))
    schema = StructType([rows.schema["doc"], *StructType.fromDDL("expected_grade double, tail_probability double").fields])
    scored = rows.mapInArrow(by_slice(work), schema)
    return scored.withColumn("kept", F.lit(True) if unfitted else F.col("tail_probability") >= keep_at)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from the table labels: 0 toxic, 1 of low quality, 2 good; null where a label is missing."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade"))


N_GRADES = 3
