"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words, hashed into `BUCKETS`. Bucket counts of the whole corpus are summed in Spark; the commonest `ALONE` buckets are outputs of
the network of their own, the others share the remaining outputs, each of about equal mass. Outputs are ordered by frequency and cut into
classes, so P(word | both sides) = P(class | window) P(output | class, window) P(bucket | output): the first two by the network (vectors of
the two words on each side, one tanh layer, a softmax over classes and one inside the class), the last from the counts. The biases begin at the
corpus frequencies. A document's score is the sum of log P over all its tokens.

Training examples are all positions of all documents, each used once. Documents are cut into slices, a hash of the document and slice deals them
to shards, whose number follows the corpus, and a shard's slices are read in the order of their hash: the result does not depend on how the table is
partitioned, up to the rounding of sums. Each round takes its own part of the shards; every shard trains a copy of the net in numpy, in batches as
they stream by, and the copies are averaged, weighted by examples. The driver receives one model a round whatever the input.

Defined cases: null text or text without words has 0 tokens, log_prob 0 and mean 0; windows are padded at a document's edges;
repeated rows get equal scores; extra columns are ignored; an empty corpus gives the untrained network and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop_stash, give_back, small_batches, stash, summed
from .features import Adam

BUCKETS = 1 << 18
CLASSES, MEMBERS, ALONE = 64, 64, 3072
OUTPUTS = CLASSES * MEMBERS
SIDE, DIM, HIDDEN = 2, 12, 32
PAD = OUTPUTS
CHUNK = 1 << 14  # positions scored together
SLICE = 1 << 12  # positions of a document that are dealt together
SHARD = 1 << 20  # positions that one copy of the net trains on in a round, about
BATCH, MIXED = 1 << 12, 1 << 15  # positions of a step; positions whose order is shuffled
PIECES = 16  # parts in which a net's numbers are summed

OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


class Net(NamedTuple):
    e: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wm: np.ndarray  # one softmax layer a class
    bm: np.ndarray


class Model(NamedTuple):
    outputs: np.ndarray  # of each bucket
    log_in_output: np.ndarray
    net: Net


def start_net(mass: np.ndarray, seed: int = 5) -> Net:
    """A net that knows only the mass of each output."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32)
    e = rng.normal(0, 0.3, (OUTPUTS + 1, DIM)).astype(np.float32)
    by_class = mass.reshape(CLASSES, MEMBERS)
    bc = np.log(by_class.sum(1) / mass.sum()).astype(np.float32)
    bm = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    return Net(e, normal(2 * SIDE * DIM, HIDDEN), np.zeros(HIDDEN, np.float32), 0.1 * normal(HIDDEN, CLASSES), bc, 0.1 * normal(CLASSES, HIDDEN, MEMBERS), bm)


def buckets_of(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1)


def assign(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output of each bucket, log share of the bucket in its output, mass of each output); half a count is added to each bucket."""
    order = np.argsort(-counts, kind="stable")
    smooth, outputs = counts + 0.5, np.zeros(BUCKETS, np.int64)
    outputs[order[:ALONE]] = np.arange(ALONE)
    rest = order[ALONE:]
    mass = np.cumsum(smooth[rest])
    outputs[rest] = ALONE + np.minimum((mass - smooth[rest]) / mass[-1] * (OUTPUTS - ALONE), OUTPUTS - ALONE - 1).astype(np.int64)
    total = np.maximum(np.bincount(outputs, smooth, OUTPUTS), 1e-3)
    return outputs.astype(np.uint16), np.log(smooth / total[outputs]).astype(np.float32), total


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all outputs with padding after each side of a document, places of the tokens)."""
    pad = np.full(SIDE, PAD, np.uint16)
    line = np.concatenate([x for d in docs for x in (d, pad)]) if docs else np.zeros(0, np.uint16)
    line = np.concatenate((pad, line, pad))
    return line, np.flatnonzero(line != PAD)


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A column a position: numpy finds largest and sum along rows of columns several times as fast."""
    z = w.T @ h.T
    z += b[:, None]
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(np.subtract(z, z.max(0), out=z), out=z)
    z /= z.sum(0)
    return z


def _own_log(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log softmax of each column at own."""
    top = z.max(0)
    picked = z[own, np.arange(len(own))] - top
    np.exp(np.subtract(z, top, out=z), out=z)
    return picked - np.log(z.sum(0))


def log_probs(net: Net, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(output | window) at each place."""
    # A vector's part of the hidden layer depends on its output number and offset alone: a table for each offset.
    tables = [net.e @ net.w1[k * DIM : (k + 1) * DIM] for k in range(2 * SIDE)]
    out = np.empty(len(at), np.float32)
    for k in range(0, len(at), CHUNK):
        own = line[at[k : k + CHUNK]]
        order = np.argsort(own, kind="stable")
        p, own = at[k : k + CHUNK][order], own[order].astype(np.int64)
        cls, mem = np.divmod(own, MEMBERS)
        h = tables[0][line[p + OFFSETS[0]]] + net.b1
        for table, offset in zip(tables[1:], OFFSETS[1:]):
            h += table[line[p + offset]]
        np.tanh(h, out=h)
        got = _own_log(_logits(h, net.wc, net.bc), cls)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            a, b = ends[c], ends[c + 1]
            got[a:b] += _own_log(_logits(h[a:b], net.wm[c], net.bm[c]), mem[a:b])
        out[k : k + CHUNK][order] = got
    return out


class Trainer:
    """A copy of a net that learns from lines of output numbers as they come."""

    def __init__(self, net: Net, rate: float, passes: int = 1):
        self.p, self.passes, self.n = [x.astype(np.float32) for x in net], passes, 0
        self.opt, self.rng = Adam([x.shape for x in self.p], rate, np.float32), np.random.default_rng(0)
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def feed(self, line: np.ndarray) -> None:
        """line: SIDE neighbours (or padding), the positions to learn, SIDE neighbours."""
        at = np.arange(SIDE, len(line) - SIDE)
        self.held.append(np.stack([line[at + k] for k in (*OFFSETS, 0)], 1))
        self.waiting += len(at)
        if self.waiting >= MIXED:
            self.learn()

    def learn(self) -> None:
        if self.held:
            rows = np.concatenate(self.held)
            for _ in range(self.passes):
                for pick in np.array_split(self.rng.permutation(len(rows)), -(-len(rows) // BATCH)):
                    self.step(rows[pick, :-1], rows[pick, -1])
            self.n += len(rows)
        self.held, self.waiting = [], 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        target = target.astype(np.uint16)  # 16-bit numbers are sorted by their digits
        order, n = np.argsort(target, kind="stable"), len(target)
        c, (cls, mem) = context[order].astype(np.uint16), np.divmod(target[order].astype(np.int64), MEMBERS)
        e, w1, b1, wc, bc, wm, bm = self.p
        x = e[c].reshape(n, -1)
        h = np.tanh(x @ w1 + b1)
        z = _softmax(_logits(h, wc, bc))
        z[cls, np.arange(n)] -= 1
        z /= n
        dh = z.T @ wc.T
        gm, gb = np.zeros_like(wm), np.zeros_like(bm)
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(ends)):
            a, b = ends[k], ends[k + 1]
            s = _softmax(_logits(h[a:b], wm[k], bm[k]))
            s[mem[a:b], np.arange(b - a)] -= 1
            s /= n
            gm[k], gb[k] = h[a:b].T @ s.T, s.sum(1)
            dh[a:b] += s.T @ wm[k].T
        dh *= 1 - h * h
        dx = (dh @ w1.T).reshape(-1, DIM)
        flat, de = c.ravel(), np.zeros_like(e)
        by = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[by].astype(np.int32), prepend=-1))
        de[flat[by[starts]]] = np.add.reduceat(dx[by], starts, axis=0)
        self.opt.step(self.p, [de, x.T @ dh, dh.sum(0), h.T @ z.T, z.sum(1), gm, gb])


def _counted(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, buckets_of(t.as_py()), 1)
        own = np.flatnonzero(n)
        for k in range(0, len(own), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 50_000], pa.int32()), pa.array(n[own[k : k + 50_000]], pa.int64())], ["bucket", "n"])

    # At most BUCKETS rows come to the driver.
    got = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return counts


def _slices(rows: DataFrame, outputs: np.ndarray) -> DataFrame:
    """(h, part, line) of every slice of SLICE positions, with neighbours; rows has h and text."""
    shared = rows.sparkSession.sparkContext.broadcast(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, parts, lines = [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = buckets_of(t.as_py())
                if len(x):
                    line, _ = padded([shared.value[x]])
                    for k in range(0, len(x), SLICE):
                        hs.append(h)
                        parts.append(k // SLICE)
                        lines.append(line[k : min(k + SLICE, len(x)) + 2 * SIDE].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(parts, pa.int32()), pa.array(lines, pa.binary())], ["h", "part", "line"])
        give_back()

    return rows.mapInArrow(run, "h long, part int, line binary")


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net]).astype(np.float64)


def _like(net: Net, flat: np.ndarray) -> Net:
    ends = np.cumsum([0, *[p.size for p in net]])
    return Net(*[flat[a:b].reshape(p.shape).astype(np.float32) for a, b, p in zip(ends[:-1], ends[1:], net)])


def _averaged(lines: DataFrame, net: Net, tasks: int, rate: float, passes: int) -> Net:
    """The average of the copies that the shards of lines (shard, key, line) train from net."""
    spark = lines.sparkSession
    now = spark.sparkContext.broadcast(net)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, shard, trainer = np.zeros(sum(p.size for p in now.value)), 0, None, None

        def close() -> int:
            trainer.learn()
            np.add(total, trainer.n * _flat(Net(*trainer.p)), out=total)
            return trainer.n

        for b in batches:
            for s, line in zip(b.column(0).to_pylist(), b.column(1)):
                if s != shard:
                    n += close() if trainer else 0
                    shard, trainer = s, Trainer(now.value, rate, passes)
                trainer.feed(np.frombuffer(line.as_buffer(), "<u2"))
        if trainer:
            n += close()
            pieces = [x.tobytes() for x in np.array_split(total, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary()), pa.array([n] * PIECES, pa.int64())], ["k", "total", "n"])
        give_back()

    dealt = lines.repartition(tasks, "shard").sortWithinPartitions("shard", "key", "line").select("shard", "line")
    got = summed(dealt.mapInArrow(local, "k int, total binary, n long"), PIECES)
    return _like(net, np.concatenate([got[k][0] / got[k][1] for k in range(PIECES)])) if got else net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, passes: int = 1, rate: float = 0.01) -> Model:
    """passes: how often a shard learns its examples; 1 but for tiny corpora."""
    text = F.col(text_col).cast("string").alias("text")
    with small_batches(docs.sparkSession):
        counts = _counted(docs.select(text))
        outputs, in_output, mass = assign(counts)
        net = start_net(mass)
        shards = max(1, -(-int(counts.sum()) // (rounds * SHARD)))
        dealt = F.pmod(F.xxhash64("h", "part"), F.lit(rounds * shards))
        lines = _slices(docs.select(F.xxhash64(F.col(id_col), text).alias("h"), text), outputs)
        lines = stash(lines.select(dealt.alias("shard"), F.xxhash64("part", "h").alias("key"), "line"), "slices")
        for r in range(rounds):
            net = _averaged(lines.where(F.col("shard") % rounds == r), net, shards, rate / (1 + r), passes)
    drop_stash(lines)
    return Model(outputs, in_output, net)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                x = [buckets_of(t.as_py()) for t in own.column(1)]
                n = np.array(list(map(len, x)), np.int64)
                line, places = padded([m.outputs[d] for d in x])
                each = log_probs(m.net, line, places) + m.log_in_output[np.concatenate(x)] if n.sum() else np.zeros(0)
                total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))[np.concatenate(([0], np.cumsum(n)))]
                total = np.diff(total)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(total / np.maximum(1, n), pa.float64())], ["id", "n_tokens", "log_prob", "mean_log_prob"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    return rows.mapInArrow(run, made).withColumnRenamed("id", id_col)


def op7_masked_lm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs))
