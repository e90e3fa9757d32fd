"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair term is taken in linear time as
half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2. Fields: hashed words of the whole text (square-root counts on the
unit sphere), structure statistics (standardised) and, as metadata, the stored length column where there is one.
Labels of about `most_labels` rows at most are used (chosen by hash); features are made on the executors, the model is
fitted in numpy on the driver, and every document is scored by its whole text.

Defined cases: null or empty text has statistics 0 and no words and gets the score of that row; null length counts as the
text's own; labelled rows without a label are not used; one class alone or no labels give its share as a constant
(0.5 without labels); repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, give_back
from .features import STATS, Adam, batch_rows, crc, hashed_words, row_sums, sampled, sigmoid, structure, words_of

BUCKETS, FACTORS = 1 << 14, 8
DENSE = STATS + 1


class Model(NamedTuple):
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)


def featurize(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(text)
    index, value = hashed_words(words, BUCKETS)
    length = len(text or "") if n_chars is None else n_chars
    return index, value, np.append(structure(text, words), np.log1p(max(0, length))).astype(np.float32)


def _forward(p, index, value, starts):
    vx = p[2][index] * value[:, None]
    s = row_sums(vx, starts)
    return row_sums(p[1][index] * value, starts) + p[0][0] + 0.5 * ((s * s).sum(1) - row_sums((vx * vx).sum(1), starts)), vx, s


def fit(index, value, starts, stats, y, epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fits on sparse rows with dense statistics; statistics follow the word buckets in the index."""
    rng, n = np.random.default_rng(seed), len(y)
    mean = stats.mean(0) if n else np.zeros(DENSE)
    scale = (stats.std(0) if n else np.zeros(DENSE)) + 1e-3
    share = float(y.mean()) if n else 0.5
    size = BUCKETS + DENSE
    if n < 2 or share in (0.0, 1.0):
        base = np.clip(share, 1e-3, 1 - 1e-3)
        return Model(float(np.log(base / (1 - base))), np.zeros(size), np.zeros((size, FACTORS)), mean, scale)
    z = np.clip((stats - mean) / scale, -4, 4) / np.sqrt(DENSE)
    p = [np.zeros(1), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))]
    opt = Adam([x.shape for x in p], rate)
    for _ in range(max(epochs, min(60, 40_000 // n))):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            at, own = batch_rows(starts, rows)
            width = np.diff(own) + DENSE
            ends = np.concatenate(([0], np.cumsum(width)))
            i, x = np.empty(ends[-1], np.int64), np.empty(ends[-1])
            is_dense = np.zeros(ends[-1], bool)
            is_dense[(ends[1:, None] - DENSE + np.arange(DENSE)).ravel()] = True
            i[is_dense], x[is_dense] = np.tile(BUCKETS + np.arange(DENSE), len(rows)), z[rows].ravel()
            i[~is_dense], x[~is_dense] = index[at], value[at]
            f, vx, s = _forward(p, i, x, ends)
            g = (sigmoid(f) - y[rows]) / len(rows)
            each = np.repeat(g, width)
            gw = np.bincount(i, each * x, size) + decay * p[1]
            pull = each[:, None] * x[:, None] * (np.repeat(s, width, axis=0) - vx)
            gv = np.stack([np.bincount(i, pull[:, k], size) for k in range(FACTORS)], 1) + decay * p[2]
            opt.step(p, [np.array([g.sum()]), gw, gv])
    return Model(float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32), mean, scale)


def score_row(m: Model, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
    i = np.concatenate((index, BUCKETS + np.arange(DENSE)))
    x = np.concatenate((value, m.dense(stats) / np.sqrt(DENSE)))
    vx = m.v[i] * x[:, None]
    f = m.w0 + m.w[i] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx * vx).sum())
    return float(sigmoid(np.float64(f)))


def _inputs(docs: DataFrame, id_col: str, text_col: str, length_col: str) -> list:
    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    return [F.col(id_col).alias("id"), F.col(text_col).alias("text"), length.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str = "n_chars", most_labels: int = 8_000) -> Model:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).where("y is not null and __id is not null")
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    known = sampled(known, "__id", most_labels, "quality")
    # At most about most_labels rows of two numbers: a bound that no input passes.
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).select(*_inputs(docs, id_col, text_col, length_col), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, n, y in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                i, x, s = featurize(t.as_py(), n)
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([i.astype("<i4").tobytes()]), pa.array([x.astype("<f4").tobytes()]), pa.array([s.astype("<f4").tobytes()])], ["y", "i", "x", "s"])

    got = rows.mapInArrow(run, "y int, i binary, x binary, s binary").collect()
    got.sort(key=lambda r: (bytes(r.i), r.y))  # the fit does not depend on the order of arrival
    index = [np.frombuffer(r.i, "<i4") for r in got]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in index]))).astype(np.int64)
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    stats = np.array([np.frombuffer(r.s, "<f4") for r in got], np.float64).reshape(-1, DENSE)
    return fit(flat(index, np.int32), flat([np.frombuffer(r.x, "<f4") for r in got], np.float32), starts, stats, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", keep: bool = False) -> DataFrame:
    """(id, score) per row, or with keep=True all columns of docs and `__score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [score_row(m, *featurize(t.as_py(), n)) for t, n in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist())]
            columns = b.columns[:-2] if keep else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64())], [f"c{k}" for k in range(len(columns))] + ["score"])
        give_back()

    key, text, length = _inputs(docs, id_col, text_col, length_col)
    rows = docs.select(*([F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)] if keep else [key]), text, length)
    fields = list(rows.schema)[:-2]
    made = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)] + [T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, made)
    if keep:
        return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("score").alias("__score"))
    return out.select(F.col("c0").alias(id_col), "score")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, **how) -> DataFrame:
    """The documents that are not rejected, all columns."""
    return score(docs, model, keep=True, **how).where(F.col("__score") >= least).select(*docs.columns)


def training_fold(labels: DataFrame) -> DataFrame:
    return labels.where(crc("doc_id") % 5 != 0)


def op6_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, training_fold(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, model)
    return out.select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
