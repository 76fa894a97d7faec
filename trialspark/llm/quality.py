"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

1. Every text becomes ``len(STATISTICS)`` numbers, in one pass without a shuffle.
2. Training rows give mean and spread of each number. Fixed random Fourier features
   approximate a Gaussian kernel over the standardised numbers.
3. Each task adds up its rows' part of the normal equations; parts are summed in a tree
   of groups of ``FAN`` rows until one is left, which is solved for ridge weights.
4. Isotonic calibration: raw scores of training rows kept out of the ridge fit are
   counted in ``BINS`` equal bins, and adjacent bins are pooled until the share of
   label 1 rises.

The driver holds (FEATURES + 1)^2 sums and ``BINS`` counts, whatever the corpus.

Defined cases: a null or empty text has the statistics of an empty text and a score;
labels of null or other than 0 and 1, and labels of unknown documents, are not learned;
a document labelled twice counts twice; without labels every score is 0.5; with labels
of one kind the score is that kind's.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, save

FEATURES = 256
GAMMA = 0.02
RIDGE = 1e-3
#: a spread below this share of the mean is rounding, not spread
ROUNDING = 1e-6
BINS = 1_000
FAN = 32
SEED = 7
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "distinct", "top_word", "repeats", "longest_run", "letters", "capitals", "digits",
    "punctuation", "symbols", "bars", "high_bytes", "log_lines", "line_length", "same_lines", "short_words", "long_words", "marked_words", "ends",
    "capital_words", "digit_words", "unclosed",
)
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[]^_`{}~\\", b"|"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7
_MARKED = re.compile(rb"[#$%&*+/<=>@^_|~]\s|[#$%&*+/<=>@^_|~]$")


def statistics(text: bytes | None) -> list[float]:
    """Shares and sizes that tell prose from lists, tables, repetition and noise."""
    text = text or b""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / n
    lines = text.split(b"\n")
    line_counts = Counter(lines)
    same = [a == b for a, b in zip(words, words[1:])]
    run = longest = 0
    for s in same:
        run = run + 1 if s else 0
        longest = max(longest, run)
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(same) / w,
        math.log1p(longest),
        float(classes[1]),
        float(classes[2]),
        float(classes[3]),
        float(classes[4]),
        float(classes[5]),
        float(classes[6]),
        float(classes[7]),
        math.log1p(len(lines)),
        math.log1p(len(text) / len(lines)),
        1 - len(line_counts) / len(lines),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(_MARKED.findall(text)) / w,
        sum(text.count(c) for c in (b". ", b".\n", b"? ", b"! ")) / w,
        sum(c for x, c in counts.items() if x[:1].isupper()) / w,
        sum(c for x, c in counts.items() if x[:1].isdigit()) / w,
        float(text.rstrip()[-1:] not in (b".", b"!", b"?")),
    ]


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row."""

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in binary(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


class Fourier:
    """Fixed features z with z(x) z(y) near exp(-gamma |x - y|^2), and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, gamma: float = GAMMA):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > ROUNDING * np.abs(mean), spread, 1.0)
        self.w = rng.normal(0, math.sqrt(2 * gamma), (len(mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.cos(scaled @ self.w + self.b) * math.sqrt(2 / self.w.shape[1])
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.array(batch.column(name).to_pylist(), np.float64).reshape(batch.num_rows, -1)


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of array columns ``v`` over all rows (pid, v), in a tree of groups of FAN rows."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.array(v) for v in group.column("v").to_pylist())
        return pa.table({"pid": pa.array([group.column("g")[0].as_py()], pa.int64()), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = save(parts, "sums")
    while (count := parts.count()) > 1:
        order = parts.select("pid", "v", F.floor(F.col("pid") / FAN).cast("long").alias("g"))
        parts = save(order.groupBy("g").applyInArrow(add, "pid long, v array<double>"), "sums")
    row = parts.first()
    return np.array(row["v"]) if row else None


def normal_equations(rows: DataFrame, features: Fourier) -> np.ndarray | None:
    """Sums of z z', z y in one square matrix over training rows (x, y)."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([shared.value(_matrix(batch)), np.array(batch.column("y").to_pylist(), np.float64)[:, None]])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["pid", "v"]
            )

    total = summed(rows.select("x", "y").mapInArrow(run, "pid long, v array<double>"))
    side = features.w.shape[1] + 2
    return total.reshape(side, side) if total is not None else None


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rising shares by pooling neighbours that fall; bins without rows take their neighbours' line."""
    some = np.flatnonzero(count)
    blocks: list[list[float]] = []
    for i in some.tolist():
        blocks.append([float(positive[i]), float(count[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, k = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += c
            blocks[-1][2] += k
    shares = np.repeat([p / c for p, c, _ in blocks], [k for _, _, k in blocks])
    return np.interp(np.arange(len(count)), some, shares)


class Model:
    """Features, ridge weights and the calibrated share of each bin of the raw score."""

    def __init__(self, features: Fourier, weights: np.ndarray, shares: np.ndarray | None = None):
        self.features, self.weights, self.shares = features, weights, shares

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Raw scores reach a little past 0 and 1."""
        return np.clip(((self.raw(x) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.shares[self.bins(x)]


def fit(rows: DataFrame, calibrate: Column, ridge: float = RIDGE) -> Model | None:
    """``rows``: stored (x, y, ...). ``calibrate`` marks the rows that the ridge fit leaves out."""
    width = len(STATISTICS)
    sums = rows.agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)],
        *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(width)],
    ).first()
    if not sums["n"]:
        return None
    mean = np.array([sums[f"s{i}"] for i in range(width)]) / sums["n"]
    spread = np.sqrt(np.maximum(np.array([sums[f"q{i}"] for i in range(width)]) / sums["n"] - mean**2, 0))
    features = Fourier(mean, spread)
    total = normal_equations(rows.where(~calibrate), features)
    if total is None:  # all rows calibrate: few labels
        total = normal_equations(rows, features)
    a, b, n = total[:-1, :-1], total[:-1, -1], total[-2, -2]
    penalty = np.eye(len(a)) * ridge * n
    penalty[-1, -1] = 0
    model = Model(features, np.linalg.lstsq(a + penalty, b, rcond=None)[0])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.bins(_matrix(batch))), batch.column("y")], names=["bin", "y"])

    held = rows.where(calibrate)
    if held.isEmpty():
        held = rows
    found = held.select("x", "y").mapInArrow(count, "bin long, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    counts, positive = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        counts[r["bin"]], positive[r["bin"]] = r["n"], r["p"]
    model.shares = isotonic(positive, counts)
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: Column, calibrate: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score): the calibrated chance of label 1, for every row."""
    described = save(describe(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    train = described.where(~held_out).join(known, F.col(id_col) == F.col("_id")).select(id_col, "x", "y")
    model = fit(save(train, "train"), calibrate)
    if model is None:
        return described.select(id_col, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(shared.value(_matrix(batch)))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return described.mapInArrow(run, f"`{id_col}` {kind}, score double")
