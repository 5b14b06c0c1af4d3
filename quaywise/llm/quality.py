"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The ratings give each labelled document a grade: 0 toxic, 1 low quality, 2 good. One
score, the sum of hashed-text weights shared by all grades, is cut by two ordered
thresholds: P(grade >= k) = sigmoid(score - threshold_k). Features are the distinct words
of the whole text (A-Z lower-cased), their beginnings of 4 and 5 bytes and ends of 2 and 3
bytes, and shape features (repetition, capitals, marks), each hashed into a fixed table.
Weights come from FTRL-proximal steps with an L1 penalty, so uninformative features stay
at zero and long texts are not put at a disadvantage.

The fit reads a bounded sample of labelled rows (``SAMPLE``, the least hashes of doc_id)
as hashed features; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .store import hashed_sample, read_table
from .textbytes import LOWER, U64, chunks, mix64, span_hashes, word_bounds

#: Labelled rows that a fit reads at most.
SAMPLE = 12_000
BITS = 19
#: A document is selected if the probability of the top grade is at least this.
SELECT = 0.5


def _distinct(owner: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((owner.astype(U64) << U64(bits)) | (hashes & U64((1 << bits) - 1)))
    return (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all texts, offsets); each text's features are distinct."""
    texts = len(offsets) - 1
    lower = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    owner = np.repeat(np.arange(texts), np.diff(first))
    words = span_hashes(lower, starts, ends)
    # distinct words of each text
    order = np.lexsort((words, owner))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    pick = order[keep]
    parts = [(owner[pick], words[pick])]
    s, e, o = starts[pick], ends[pick], owner[pick]
    for k, salt in ((4, 1), (5, 2)):
        ok = e - s > k
        parts.append((o[ok], mix64(span_hashes(lower, s[ok], s[ok] + k) + U64(salt))))
    for k, salt in ((2, 3), (3, 4)):
        ok = e - s > k
        parts.append((o[ok], mix64(span_hashes(lower, e[ok] - k, e[ok]) + U64(salt))))
    # shape of the text: shares, in eighths
    n = np.maximum(np.diff(first), 1)
    count = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), np.minimum(offsets[:-1], len(mask))) * (np.diff(offsets) > 0)
    size = np.maximum(np.diff(offsets), 1)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    upper = (data >= 65) & (data <= 90)
    mark = (data > 32) & (data < 127) & ~((lower >= 97) & (lower <= 122)) & ~((data >= 48) & (data <= 57))
    digit = (data >= 48) & (data <= 57)
    shares = [
        np.bincount(owner[pick], minlength=texts) / n,
        np.bincount(owner, weights=same, minlength=texts) / n,
        count(upper) / size,
        count(mark) / size,
        count(digit) / size,
        np.minimum(size / n / 16, 1),
    ]
    for j, share in enumerate(shares):
        level = np.ceil(np.clip(share, 0, 1) * 8).astype(np.int64)
        parts.append((np.arange(texts), mix64((level * 64 + j + 1000).astype(U64))))
    owner, feature = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), bits)
    return feature, np.searchsorted(owner, np.arange(texts + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights and ordered thresholds of a cumulative-link model."""

    def __init__(self, grades: int = 3, bits: int = BITS):
        self.grades, self.bits = grades, bits
        self.weights = np.zeros(1 << bits, dtype=np.float32)
        self.thresholds = np.arange(grades - 1, dtype=np.float64) - 0.5 * (grades - 2)

    def scores(self, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feature], dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... , a column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, epochs: int = 30, batch: int = 128, alpha: float = 0.3, l1: float = 8.0, seed: int = 5) -> OrdinalModel:
        """``rows``: the features of each document. A fit of no rows or one grade leaves flat thresholds."""
        size = 1 << self.bits
        z, n = np.zeros(size), np.zeros(size)
        w = np.zeros(size)
        gaps = np.zeros(self.grades - 2)
        rng = np.random.default_rng(seed)
        if len(rows):
            counts = np.bincount(grade, minlength=self.grades) + 0.5
            tail = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
            self.thresholds = -np.log(tail / (1 - tail))
            gaps = np.log(np.maximum(np.diff(self.thresholds), 0.1))
        base = float(self.thresholds[0]) if len(rows) else 0.0
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                feature = np.concatenate([rows[i] for i in part])
                group = np.repeat(np.arange(len(part)), lengths[part])
                score = np.bincount(group, weights=w[feature], minlength=len(part))
                theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
                bounds = np.concatenate([[-np.inf], theta, [np.inf]])
                y = grade[part]
                a, b = _sigmoid(score - bounds[y]), _sigmoid(score - bounds[y + 1])
                a, b = np.where(y == 0, 1.0, a), np.where(y == self.grades - 1, 0.0, b)
                slope = a + b - 1.0  # derivative of the loss by the score
                g = np.bincount(feature, weights=slope[group], minlength=size)
                touched = np.flatnonzero(g)
                gt = g[touched]
                old = n[touched]
                n[touched] = old + gt * gt
                z[touched] += gt - (np.sqrt(n[touched]) - np.sqrt(old)) / alpha * w[touched]
                zt = z[touched]
                w[touched] = np.where(np.abs(zt) <= l1, 0.0, -(zt - np.sign(zt) * l1) / ((1.0 + np.sqrt(n[touched])) / alpha))
                # thresholds, by their own small steps
                p = np.maximum(a - b, 1e-9)
                up = np.zeros(self.grades - 1)
                np.add.at(up, y[y > 0] - 1, (a * (1 - a) / p)[y > 0])
                np.add.at(up, y[y < self.grades - 1], -(b * (1 - b) / p)[y < self.grades - 1])
                base -= 0.02 * up.sum() / len(part)
                for j in range(len(gaps)):
                    gaps[j] -= 0.02 * up[j + 1 :].sum() * np.exp(gaps[j]) / len(part)
        if len(rows):
            self.thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        self.weights = w.astype(np.float32)
        return self


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 low quality, 2 good; the least grade of a document rated twice; null ratings don't count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` distinct rows (doc_id, text) of labelled documents, whole texts.

    Null text counts as empty; rows of a repeated doc_id count one by one, copies of a row once. Rows go into the fit
    in the order of doc_id and features, so equal tables give equal models. No rated document,
    or an empty table: a model of no weights. Further columns are ignored, whatever their names.
    """
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(grades(labels), "doc_id")
    picked = hashed_sample(rated, sample, ["grade"]).select("text", "grade", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                feature, at = features(data, offsets)
                rows = [feature[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "grade", "features"])

    found = picked.mapInArrow(run, "doc_id long, grade int, features binary").toArrow()
    held = sorted(zip(*(found.column(k).to_pylist() for k in range(3))))
    return OrdinalModel().fit([np.frombuffer(x, dtype="<u4") for _, _, x in held], np.array([g for _, g, _ in held], dtype=np.int64))


def score_quality(docs: DataFrame, model: OrdinalModel, keep_columns: bool = False, names: tuple[str, str, str] = ("expected_grade", "tail_probability", "selected")) -> DataFrame:
    """Expected grade, probability of the top grade and selection of every whole text, by the given names.

    With doc_id, or with all columns of ``docs``; a column that has one of the names is then
    replaced (give others to keep it). Null text counts as empty. Rows are independent: ties and
    repeated rows get equal scores, long texts are read whole, an empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2 MB, whatever the corpus
    table = docs.drop(*names) if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = [f for f in table.schema.fields if keep_columns or f.name == "doc_id"]
    columns = [f.name for f in kept]
    at_text = table.columns.index("text")
    places = [table.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel()
        own.weights, own.thresholds = weights.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(at_text)):
                tails = own.tails(own.scores(*features(data, offsets)))
                arrays = [batch.column(k).slice(lo, hi - lo) for k in places]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= SELECT)], [*columns, *names])

    added = [StructField(names[0], DoubleType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())]
    return table.mapInArrow(run, StructType([*kept, *added]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of every whole text of ``documents``: see fit_quality and score_quality, also for the odd cases."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
