"""Language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties
and calibrated by one temperature.  Document frequencies cover all training
texts; the weights are fitted on a bounded sample, drawn by hash: at most
``per_label`` distinct texts of each language, and no more than ``sample_bytes``
of n-gram counts in all.  Only n-grams that keep a weight after the penalties are
stored and sent to the executors.  Prediction is one pass over whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, written

UNKNOWN = "und"
#: The weights of a trained model take 8 bytes an n-gram and label: 262 MB at this many labels, the most there may be.
MOST_LABELS = 500
#: Rows given back at once, so that an executor holds one batch of texts a task, not two.
PART = 256
ORDERS = (1, 2, 3)
# Odd multipliers of the n-gram hash, one for each place in the n-gram.
MULTIPLIERS = (2654435761, 2246822519, 3266489917)


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text, lower-cased, and how often each occurs."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - bits)
    found = []
    rolled = None
    for n in ORDERS:
        if len(cp) < n:
            break
        place = cp[n - 1 :] * np.uint32(MULTIPLIERS[n - 1]) if rolled is not None else cp * np.uint32(MULTIPLIERS[0])
        rolled = place if rolled is None else (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(MULTIPLIERS[1]) + place
        mixed = rolled ^ (rolled >> np.uint32(16))
        found.append((mixed * np.uint32(MULTIPLIERS[2] + 2 * n)) >> shift)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.concatenate(found)
    if len(ids) > 2000:
        count = np.bincount(ids, minlength=1)
        seen = np.flatnonzero(count)
        return seen, count[seen]
    return np.unique(ids, return_counts=True)


@dataclass
class Model:
    """``weights`` has a row for each n-gram that kept one, ``row`` its place by n-gram, or -1."""

    labels: list[str]
    idf: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts.astype(np.float64))) * self.idf[ids]
        return (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float64)

    def logits(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = self.row[ids]
        known = at >= 0
        return x[known] @ self.weights[at[known]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        ids, counts = grams(text, self.bits)
        z = self.logits(ids, self.vector(ids, counts)) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.labels[best], float(p[best] / p.sum())


def fit(
    examples: list[tuple[str, np.ndarray, np.ndarray]],
    frequency: np.ndarray,
    total: int,
    bits: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    epochs: int = 2,
) -> Model:
    """Fit weights on (label, ids, counts); every fifth example is left for the temperature."""
    labels = sorted({e[0] for e in examples})
    size, k = 1 << bits, len(labels)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    model = Model(labels, idf, np.full(size, -1, np.int32), np.zeros((0, k)), np.zeros(k), 1.0, bits)
    if not examples:
        return model
    at = {v: i for i, v in enumerate(labels)}
    rest = [e for i, e in enumerate(examples) if i % 5 == 4] if len(examples) >= 5 * k else []
    learn = [e for i, e in enumerate(examples) if i % 5 != 4] if rest else examples
    seen = np.zeros(size, bool)
    for _, ids, _ in learn:
        seen[ids] = True
    own = np.flatnonzero(seen)
    place = np.zeros(size, np.int64)
    place[own] = np.arange(len(own))
    # Rows of the n-grams that occur, and a last one for the bias.
    z, n = np.zeros((len(own) + 1, k)), np.zeros((len(own) + 1, k))

    def weights(zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for label, ids, counts in learn:
            rows = np.append(place[ids], len(own))
            x = np.append(model.vector(ids, counts), 1.0)
            zi, ni = z[rows], n[rows]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[at[label]] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[rows] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[rows] = more
    fitted = weights(z, n)
    kept = np.flatnonzero((fitted[:-1] != 0).any(1))
    model.row[own[kept]] = np.arange(len(kept))
    model.weights, model.bias = fitted[kept], fitted[-1]
    if rest:
        scores = np.array([model.logits(ids, model.vector(ids, counts)) for _, ids, counts in rest])
        truth = np.array([at[e[0]] for e in rest])

        def loss(t: float) -> float:
            s = scores / t
            top = s.max(1)
            return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), truth]).mean() + 1e-3 * np.log(t) ** 2)

        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 47))
        model.temperature = float(min(grid, key=loss))
    return model


def train(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    bits: int = 16,
    per_label: int = 1000,
    sample_bytes: int = 96 << 20,
) -> Model:
    """Train on the rows of ``df`` that have an id, a text and a label.

    Document frequencies are counted over all of them, by task, and summed.  The
    sample is the ``per_label`` distinct rows of each label with the least hashes
    of id and text, cut to ``sample_bytes`` divided by the labels, but one row a
    label at least; what reaches the driver is the n-gram counts of these, 4 or 8
    bytes an n-gram.  A row repeated any number of times is one example.  The
    order of training is that of the hashes, so that the model depends on the
    rows alone.  No such rows give a model that knows no label.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where(
        "label is not null and text is not null and id is not null"
    )
    size = 1 << bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for text in b.column(0):
                seen[grams(text.as_py(), bits)[0]] += 1
                total += 1
        seen[size] = total
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    counted = rows.select("text").mapInArrow(lean(frequencies), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    frequency = np.zeros(size + 1, np.int64)
    for r in counted.collect():  # at most 2**bits + 1 rows
        frequency[r["at"]] = r["n"]
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{len(counts)} labels; the model is for {MOST_LABELS} at most")
    if not counts:
        return fit([], frequency[:size], 0, bits)
    ranked = rows.withColumn("rank", F.xxhash64("id", "text"))
    # Ranks are uniform over distinct rows, so a label's count says below which rank about four samples' worth of
    # its rows lie: only those are sorted, however common the label.  Where copies leave too few, the limit is raised.
    below = {label: min(1.0, 4 * per_label / n) for label, n in counts.items()}
    while True:
        limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
        low = ranked.where(F.col("rank") / F.lit(2.0**64) + 0.5 <= limits[F.col("label")])
        order = Window.partitionBy("label").orderBy("rank")
        few = low.select("label", "rank").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label)
        chosen = few.select("label", "rank").collect()  # at most per_label a label
        got = Counter(r["label"] for r in chosen)
        short = [v for v in below if got[v] < per_label and below[v] < 1]
        if not short:
            break
        below |= {v: min(1.0, 16 * below[v]) for v in short}
    picked = spark.createDataFrame(chosen, few.select("label", "rank").schema)
    sample = ranked.join(F.broadcast(picked), ["label", "rank"])  # per_label * MOST_LABELS rows of 8 bytes and a label at most
    sample = sample.groupBy("label", "rank").agg(F.min("text").alias("text"))
    width = np.uint16 if bits <= 16 else np.uint32

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [grams(t.as_py(), bits) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([x[0].astype(width).tobytes() for x in found], pa.binary()),
                        # Weights are of logarithms: counts from 65,535 on are taken as that.
                        pa.array([np.minimum(x[1], 65535).astype(np.uint16).tobytes() for x in found], pa.binary()),
                    ],
                    ["label", "rank", "ids", "counts"],
                )

    made = sample.select("label", "rank", "text").mapInArrow(lean(features), "label string, rank long, ids binary, counts binary")
    made, path = written(made, "sample")
    # A running sum over a label's sample, which is at most per_label rows.
    so_far = F.sum(F.octet_length("ids") + F.octet_length("counts")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fits = made.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") <= sample_bytes // len(counts))
    examples = [(r["rank"], r["label"], np.frombuffer(r["ids"], width), np.frombuffer(r["counts"], np.uint16)) for r in fits.drop("before").toLocalIterator()]
    discard(spark, path)
    examples.sort(key=lambda e: (e[0], e[1]))
    return fit([e[1:] for e in examples], frequency[:size], int(frequency[size]), bits)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score.

    ``und`` with score 0 if the text is null, empty or has no letter, or if the
    model saw no label.  Ties go to the label that sorts first.  Columns of
    those names in ``df`` are replaced.
    """
    df = df.drop("lang_pred", "score")
    names, at = df.columns, df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # at most 2**bits * MOST_LABELS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            for start in range(0, b.num_rows, PART):
                part = b.slice(start, PART)
                out = [model.predict(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                    [*names, "lang_pred", "score"],
                )

    from pyspark.sql.types import DoubleType, StringType, StructType

    return df.mapInArrow(lean(run), StructType([*df.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))
