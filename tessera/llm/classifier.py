"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features cos(w.x + b) approximate a Gaussian kernel over standardised statistics. Each partition adds up its part
of the normal equations into one row, the rows are summed in a tree of tasks, and the driver solves a system whose size is that of the
feature map. The ridge scores of the rows that the ridge was fitted to are counted in bins of fixed width; pool-adjacent-violators over the
bins makes the score a calibrated, monotone probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, read, small_batches

#: Names of the statistics, in the order in which `statistics()` gives them.
NAMES = (
    "log_chars", "log_words", "word_length", "unique_words", "top_word", "upper", "digits", "symbols", "punctuation",
    "non_ascii", "byte_entropy", "compressed", "line_length", "repeated_lines", "ended_lines", "marked_words", "long_words", "short_words",
)
BINS = 500
#: Partial sums that one task adds up.
FAN_IN = 16


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(b"#*$%&|<>@^~=_+\\{}[]!"),
        _class(b".,;:?'\"()-"),
        _class(bytes(range(128, 256))),
    ]
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    share = counts[counts > 0] / size
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    marked = sum(c for w, c in seen.items() if not w[:1].isalnum() and w[0] < 128 or w[-1] in b"#*$%&|<>!=~^")
    return [
        np.log1p(size),
        np.log1p(n),
        float(lengths.mean()),
        len(seen) / n,
        max(seen.values()) / n,
        *(CLASSES @ counts / size).tolist(),
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / size,
        np.log1p(size / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":") for x in lines) / len(lines),
        marked / n,
        float((lengths > 14).mean()),
        float((lengths < 3).mean()),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns and x, array<double>: the statistics of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(v.as_py() or "") for v in batch.column(batch.num_columns - 1)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(x)], names=[*names, "x"])

    names = ["id", *carried]
    picked = docs.select(F.col(id_col).alias("id"), *carried, F.col(text_col).alias("_stat_value"))
    return small_batches(picked).mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


@dataclass
class Model:
    """mean, scale: of the statistics; w, b: the feature map; beta: ridge weights; cuts, levels: the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.cuts, self.levels)


def summed(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], np.ndarray]) -> np.ndarray:
    """The sum of the arrays that `run` makes of each partition: one row of bytes for each, added up in ever fewer tasks, the last FAN_IN rows or fewer on the driver."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"v": [run(frames).astype(np.float64).tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((np.frombuffer(v) for f in frames for v in f["v"]), 0.0)
        yield pd.DataFrame({"v": [] if isinstance(total, float) else [total.tobytes()]})

    parts = rows.mapInPandas(first, "v binary")
    width = rows.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInPandas(add, "v binary")
    found = [np.frombuffer(r.v) for r in parts.collect()]  # FAN_IN rows of fixed size
    return np.sum(found, axis=0) if found else np.zeros(0)


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(NAMES)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    d = len(NAMES)

    def run(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(2 * d + 1)
        for f in frames:
            x = matrix(f["x"])
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        return total

    total = summed(rows, run)
    n = max(1.0, total[-1]) if len(total) else 1.0
    mean = total[:d] / n if len(total) else np.zeros(d)
    scale = np.sqrt(np.maximum(total[d : 2 * d] / n - mean**2, 0)) if len(total) else np.ones(d)
    return mean, np.where(scale > 1e-9, scale, 1.0), n


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of positive / count, weighted by count (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count):
        blocks.append([p, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), p / c) for p, c, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, *, size: int = 192, width: float = 4.0, ridge: float = 0.3, seed: int = 7) -> Model:
    """A model from rows (x array<double>, y int). `size`: random features; `width`: of the kernel, in standard deviations;
    `ridge`: penalty of a weight, in rows. Without rows the model scores 0.5 throughout; a row whose x or y is null is left out."""
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL")
    mean, scale, n = moments(rows)
    rng = np.random.default_rng(seed)
    m = Model(mean, scale, rng.normal(size=(len(NAMES), size)) / width, rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.array([0.0]), np.array([0.5]))
    upper = np.triu_indices(size + 1)

    def equations(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        gram, right = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
        for f in frames:
            z = m.features(matrix(f["x"]))
            gram += z.T @ z
            right += z.T @ f["y"].to_numpy(float)
        return np.concatenate([gram[upper], right])

    total = summed(rows, equations)
    if not len(total) or not total[0]:
        return m
    gram = np.zeros((size + 1, size + 1))
    gram[upper] = total[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    penalty = np.full(size + 1, ridge)
    penalty[0] = 1e-9
    m.beta = np.linalg.solve(gram + np.diag(penalty), total[len(upper[0]) :])

    def binned(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(2 * BINS)
        for f in frames:
            at = np.clip(((m.raw(matrix(f["x"])) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
            y = f["y"].to_numpy(float)
            total += np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])
        return total

    total = summed(rows, binned)
    positive, count = total[:BINS], total[BINS:]
    full = count > 0
    # a little of the ridge score keeps the order within a level
    centres = ((np.arange(BINS) + 0.5) * 2 / BINS - 0.5)[full]
    levels = isotonic(positive[full], count[full])
    m.cuts, m.levels = centres, np.clip(0.995 * levels + 0.005 * np.clip(centres, 0, 1), 0, 1)
    return m


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with score, double, in place of x, their last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carried: tuple[str, ...] = (), **model: float) -> DataFrame:
    """One row per row of `docs`: `id_col`, the carried columns, held_out, score (0 to 1), predicted.

    Learns from the rows of `labels` whose id is not held out; of several labels of an id the largest counts, null
    labels and ids do not. A null or empty text has statistics of zero and is scored like any other. Nothing but the text
    goes into the score. A null id is not held out. Repeated rows each give a row.
    """
    x = materialize(with_statistics(docs, id_col, text_col, carried), "quality-statistics")
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    # three passes go over the training rows
    training = materialize(x.where(~held_out(F.col("id"))).join(y, "id").select("x", "y"), "quality-training")
    m = fit(training, **model)
    out = F.coalesce(held_out(F.col("id")), F.lit(False))
    return scored(x, m).select(F.col("id").alias(id_col), *carried, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
