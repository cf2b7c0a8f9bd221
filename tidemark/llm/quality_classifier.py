"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics of every whole text are made once and staged. Standardisation, normal equations and the bins that
calibrate are sums over partitions, so only fixed-size results reach the driver: the square of the number of
features, and at most `bins` rows.

Defined cases: a null text counts as an empty one and gets a score from zero statistics; labelled rows with
another label than 0 or 1, or without a document, don't train; with no labelled rows every score is 0.5; a label given twice
counts twice; other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, per_text, remainder, staged

FEATURES = 256
RIDGE = 1e-2
BINS = 1000
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
NAMES = ("log_bytes", "log_words", "word_length", "symbols", "digits", "upper", "marks", "bars", "wide", "distinct", "short_words", "dup_lines", "line_words", "top_word", "stops", "repeats")


def statistics(text: bytes | None) -> list[float]:
    """Figures of one whole text; ratios are by byte, word or line."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, w, k = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    of = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    solid = len(text.translate(None, SPACE))
    distinct = set(words)
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), min(solid / w, 40.0), 10 * of(b"#*$%&<>{}[]=_~^\\/"), 10 * of(b"0123456789"), 5 * of(bytes(range(65, 91))),
        10 * of(b"!?;:"), 10 * of(b"|"), 5 * (1 - len(text.decode("utf-8", "replace")) / n), len(distinct) / w, sum(map(len, distinct)) / max(len(distinct), 1) / 10,
        (len(lines) - len(set(lines))) / k, np.log1p(len(words) / k), max(0.0, 1 - len(distinct) / w) * np.log1p(w), 10 * of(b".,"), 1 - len(set(pairs)) / max(len(pairs), 1),
    ]


def _statistics_of(batch: list[bytes | None]) -> dict:
    return {"x": pa.array([statistics(t) for t in batch], pa.list_(pa.float64()))}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(df: DataFrame, fn, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of the matrices that fn(x, y) makes of their rows (x array, y label)."""
    rows, width = shape[0], len(NAMES)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = fn(_matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), shape[1])):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "v"])

    out = np.zeros(shape)
    partials = df.select("x", "y").mapInArrow(part, "i int, v array<double>")
    for row in partials.repartition("i").mapInArrow(add, "i int, v array<double>").collect():
        out[row["i"]] += row["v"]
    return out


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: rising means of total / weight, in the order of x."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t1, w1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + w1, blocks[-1][2] + n1]
    return np.concatenate([np.full(n, t / w) for t, w, n in blocks]) if blocks else np.zeros(0)


class Projection:
    """Random Fourier features of standardised statistics, and a ridge model on them."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = 3.0, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = draw.normal(0, 1 / width, (len(mean), features - len(mean) - 1))
        self.phase = draw.uniform(0, 2 * np.pi, self.w.shape[1])
        self.beta = np.zeros(features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.phase), 0.1 * z, np.ones((len(z), 1))])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; learns from labels whose fold mod 4 isn't 2."""
    stats = staged(per_text(docs, _statistics_of, "x array<double>"))
    wanted = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & (remainder(F.col("doc_id"), 4) != 2))
    train = staged(stats.join(wanted, "doc_id").select("x", "y"))
    p = len(NAMES)
    sums = _summed(train, lambda x, y: np.vstack([np.ones(p) * len(x), x.sum(0), (x * x).sum(0)]), (3, p))
    result = stats.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    if not sums[0, 0]:
        return result.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    mean = sums[1] / sums[0]
    model = Projection(mean, np.sqrt(np.maximum(sums[2] / sums[0] - mean**2, 1e-6)))
    d = len(model.beta)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model(x)
        return np.vstack([z.T @ z, y @ z])

    equations = _summed(train, normal, (d + 1, d))
    model.beta = np.linalg.solve(equations[:d] + RIDGE * np.trace(equations[:d]) / d * np.eye(d), equations[d])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model(x) @ model.beta + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]).astype(float)

    bins = _summed(train, binned, (2, BINS))
    full = np.flatnonzero(bins[0])
    level = isotonic(full, bins[1][full] + 0.5 * bins[1].sum() / bins[0].sum(), bins[0][full] + 0.5)
    middle = (full + 0.5) * 2 / BINS - 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.clip(np.interp(model(_matrix(b.column(2), p)) @ model.beta, middle, level), 0, 1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = result.select("doc_id", "held_out", "x").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
