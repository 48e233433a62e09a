"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a score quantile.

Every pair of a better and a worse labelled text says that the better one's score should be higher; the weights minimise the logistic
loss of the score differences, which are the weighted feature differences. Features come from the text alone: the share of each ASCII
byte, and how words and lines repeat. Learning uses a bounded, value-hashed sample of the labelled rows (``most`` of them) and ``pairs``
pairs drawn with a fixed seed, better and worse rows in turn, so that a rare class is used in full.

The threshold is the quantile of the learnt rows' scores at the share of worse labels (midway between its two neighbours). Scores leave as a logistic
value shifted so that the threshold maps to ``cut``: a text is accepted if its score is at least ``cut``.

Null text is empty text; both get the score of their all-zero features. Labels that are null, or differ for one key, are not learnt
from. With one class of labels or none there is no preference: every score is 1 or 0 for that class, or 1 without any label.
Repeated rows give repeated results. ``score`` returns the key and its own columns only; ``keep`` returns the input's columns.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import documents, fold, slices, uniform

SHAPE = 9
FEATURES = 129 + SHAPE
CUT = 0.3


def shape(text: bytes) -> list[float]:
    """How words and lines repeat; all in [0, 1] but for the logarithms."""
    words, lines = text.split(), text.split(b"\n")
    if not words:
        return [0.0] * SHAPE
    n, counts = len(words), Counter(words)
    same = sum(map(eq, words, words[1:]))
    return [
        np.log1p(n), len(counts) / n, max(counts.values()) / n, same / n, np.log(len(text) / n), len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)), sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalpha, words)) / n,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.minimum(np.frombuffer(b"".join(texts), np.uint8), 128).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)) * 129, sizes)
    share = np.bincount(owner + flat, minlength=129 * len(texts)).reshape(len(texts), 129) / np.maximum(sizes, 1)[:, None]
    return np.concatenate([np.sqrt(share), np.array([shape(t) for t in texts]).reshape(len(texts), SHAPE)], axis=1).astype(np.float32)


def fit(x: np.ndarray, better: np.ndarray, pairs: int = 60_000, rounds: int = 40, decay: float = 1e-4) -> dict:
    """Weights, centre and spread of the features, and the threshold at the quantile of the worse rows' share."""
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    centre, spread = x.mean(axis=0) if len(x) else np.zeros(FEATURES), x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES)
    model = {"centre": centre, "spread": spread, "weights": np.zeros(x.shape[1]), "threshold": 0.0}
    if not len(good) or not len(bad):
        return model | {"constant": float(not len(bad))}
    z = (x - centre) / spread
    draw = np.random.default_rng(11)
    first, second = (draw.permuted(np.resize(side, max(pairs, len(side)))) for side in (good, bad))
    n = min(len(first), len(second))
    first, second = first[:n], second[:n]
    w, mean, square, step = np.zeros(x.shape[1]), 0.0, 0.0, 0
    for _ in range(rounds):
        for at in np.array_split(draw.permutation(n), max(1, n // 2048)):
            d = z[first[at]] - z[second[at]]
            loss_slope = -1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope = d.T @ loss_slope / len(at) + decay * w
            step += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            w = w - 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    margins = np.sort(z @ w)
    return model | {"weights": w, "threshold": float(margins[len(bad) - 1 : len(bad) + 1].mean())}


def scores(model: dict, x: np.ndarray, cut: float = CUT) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    margins = ((x - model["centre"]) / model["spread"]) @ model["weights"] - model["threshold"] + np.log(cut / (1 - cut))
    return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 12_000) -> dict:
    """The model of a sample of at most about ``most`` labelled rows; their keys are few enough to be sent to every task."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    share = most / max(1, known.count())
    agreed = known.where(uniform("k") < share).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("k", "y")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("text")).join(F.broadcast(agreed), "k").select("y", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features([t or b"" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])

    found = rows.mapInArrow(run, "y int, x array<float>").toArrow()  # bounded: most * FEATURES numbers
    order = np.lexsort(np.array(found.column("x").to_pylist(), np.float32).reshape(-1, FEATURES).T[::-1]) if found.num_rows else []
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, FEATURES)[order]
    return fit(x, np.array(found.column("y").to_pylist(), np.int64)[order] > 0 if found.num_rows else np.zeros(0, bool))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(key, score, predicted) of every whole text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = scores(model, features([t or b"" for t in part.column("text").to_pylist()]), cut)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["k", "score", "predicted"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("k", key)


def keep(docs: DataFrame, model: dict, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows whose text is accepted, with all their columns."""
    column = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                s = scores(model, features([(t or "").encode() for t in part.column(column).to_pylist()]), cut)
                yield part.filter(pa.array(s >= cut))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    done = score(docs, learn(docs, labels))
    return done.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
