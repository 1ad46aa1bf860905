"""Quality classifier learnt from positives and unlabelled text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

# Classes of bytes: white space, letters by case, digits, each common mark, the rest.
MARKS = b".,;:!?'\"()-|/#$%&*+<=>@[]^_{}~\\`"
CLASSES = np.full(256, 5, dtype=np.int64)
CLASSES[[9, 10, 11, 12, 13]], CLASSES[32] = 0, 1
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 2, 3, 4, 2
for _number, _mark in enumerate(MARKS):
    CLASSES[_mark] = 6 + _number
N_CLASSES = 6 + len(MARKS)
N_FEATURES = N_CLASSES + 64 + 8

#: Rows the model is fitted on at most; everything else covers all rows.
POSITIVES, UNLABELLED = 4096, 8192


def features(text: str) -> np.ndarray:
    """Shares of byte classes and of their coarse pairs, repetition and lengths."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    kinds = CLASSES[raw]
    coarse = np.minimum(kinds, 7)
    out[:N_CLASSES] = np.sqrt(np.bincount(kinds, minlength=N_CLASSES) / len(raw))
    out[N_CLASSES : N_CLASSES + 64] = np.sqrt(np.bincount(coarse[:-1] * 8 + coarse[1:], minlength=64) / len(raw))
    words = text.split()
    n = max(1, len(words))
    kinds_of_word = Counter(words)
    top = kinds_of_word.most_common(2)
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.count("\n") + 1
    out[-8:] = (
        len(kinds_of_word) / n / (1 + np.log1p(n) / 10) if words else 0,
        top[0][1] / n if top else 0,
        top[1][1] / n if len(top) > 1 else 0,
        same / n,
        np.log1p(len(raw) / n),
        np.log1p(n) / 10,
        np.log1p(n / lines) / 10,
        1,
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((rows - self.centre) / self.spread, -8, 8) @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def descend(gradient, width: int, steps: int, rate: float = 0.02) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from scores that tell the two apart.

    The smallest ratio, over thresholds, of the unlabelled to the positive rows above
    it, with a confidence margin against thresholds that few rows pass.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    above_p, above_u = ((x[:, None] >= cuts).mean(axis=0) for x in (positive, unlabelled))
    margin = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, decay: float = 1e-4) -> Model:
    """A linear model of least non-negative unbiased risk (logistic loss).

    The risk is prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)):
    when the second part turns negative, its gradient is followed the other way.
    Without positives or unlabelled rows every score is the prior of one half.
    """
    width = N_FEATURES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.zeros(width), np.ones(width), 0.5)
    centre, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    centre[-1], spread[-1] = 0, 1  # the constant
    p, u = (np.clip((x - centre) / spread, -8, 8) for x in (positive, unlabelled))

    def told_apart(w: np.ndarray) -> np.ndarray:
        return -(p.T @ sigmoid(-(p @ w))) / len(p) + u.T @ sigmoid(u @ w) / len(u) + decay * w

    first = descend(told_apart, width, steps // 2)
    prior = class_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        on_p, on_u = p @ w, u @ w
        negative = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
        toward = u.T @ sigmoid(on_u) / len(u) - prior * (p.T @ sigmoid(on_p)) / len(p)
        return -prior * (p.T @ sigmoid(-on_p)) / len(p) + (toward if negative >= 0 else -toward) + decay * w

    return Model(descend(risk, width, steps), centre, spread, prior)


def held_out(row_id: Column) -> Column:
    return F.crc32(row_id.cast("string")) % 4 == 2


def vectors(rows: DataFrame, *kept: str) -> DataFrame:
    kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in kept)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            values = [features(text) for text in batch.column("body").to_pylist()]
            lists = pa.array(values, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), lists], [*kept, "vector"])

    return rows.mapInArrow(compute, f"{kinds}, vector array<float>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """Fits on samples by hash of the id, of at most the two numbers of rows.

    Trusted positives are rows that ``labels`` mark 1 and that are not held out;
    labels of 0 are not used. Unlabelled rows are any that are not held out. Nulls in
    ids or labels are no positives.
    """
    def sample(ids: DataFrame, kind: int, n: int) -> DataFrame:
        mine = ids.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
        return mine.orderBy(F.xxhash64("id", F.lit(kind)), "id").limit(n).withColumn("kind", F.lit(kind))

    marked = labels.where(labels[label_col] == 1).select(labels[id_col].alias("id"))
    wanted = sample(marked, 1, positives).unionByName(sample(docs.select(docs[id_col].alias("id")), 0, unlabelled))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(wanted), "id")  # bounded by the two numbers
    data = vectors(rows.select("kind", "body"), "kind").toPandas()
    matrix = np.stack(data["vector"].to_numpy()).astype(float) if len(data) else np.zeros((0, N_FEATURES))
    kinds = data["kind"].to_numpy()
    return fit(matrix[kinds == 1], matrix[kinds == 0])


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """Columns ``id``, ``held_out``, ``score``; one row per input row, in one pass.
    With ``with_row`` also ``row``, all input columns as a struct.

    Defined results: null and empty texts have all-zero features and the score the
    model gives those. A null id is not held out. Repeated rows and ties pass row by
    row; an empty table gives no rows.
    """
    kept = ["id"] + ["row"] * with_row
    row = [F.struct(*(docs[x] for x in docs.columns)).alias("row")] * with_row
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"), *row)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            values = model.scores(np.stack([features(text) for text in batch.column("body").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(values, pa.float64())], [*kept, "score"])

    fields = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in kept)
    scored = rows.mapInArrow(score, f"{fields}, score double")
    return scored.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", *kept[1:])
