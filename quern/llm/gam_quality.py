"""Quality classifier: a generalised additive model with pairwise interactions.

Fifteen surface features of a document are cut into quantile bins.  Cyclic
gradient boosting visits the features in turn and adds a shallow tree on one
feature's histogram to that feature's table; then the strongest pairs, by the
gain of a cross-shaped cut on the residuals, get two-way tables in the same way.
A document's logit is the intercept plus one table entry a feature and pair.

Training uses a bounded sample of labelled rows (TRAIN_ROWS, those with the
least hashes of their ids); scoring covers every document.

Defined cases: labels of one document are averaged, nulls ignored, a mean of at
least 1/2 counts as good; of rows that repeat a labelled id the one of least
features trains; a null text scores like an empty one; an empty text
has all features 0; documents without a label are scored like all others; with
no labelled rows or one class only, the model is that class's constant and keeps
every document unless all labels are bad.  Only doc_id and text are read, so
clashing columns do not matter; repeated rows are scored each; long texts are
read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import lean, span_hash, texts, word_bounds

FEATURES = ("log_bytes upper symbol digit space non_ascii word_len distinct repeat stops newline pipe top_word capital log_words").split()
#: Bound of the training sample, bins of a feature, rounds of boosting, number of pairs.
TRAIN_ROWS, BINS, ROUNDS, PAIRS, PAIR_ROUNDS = 8000, 32, 120, 4, 40
RATE, KEEP = 0.15, 0.5

_CLASS = np.zeros((256, 8), np.int32)  # upper, letter, symbol, digit, space, non-ASCII, stop, newline
_CLASS[65:91, 0] = 1
_CLASS[65:91, 1] = _CLASS[97:123, 1] = 1
_CLASS[[ord(c) for c in "!#$%&*@^~<>{}=_+|\\/"], 2] = 1
_CLASS[48:58, 3] = 1
_CLASS[[9, 10, 13, 32], 4] = 1
_CLASS[128:, 5] = 1
_CLASS[[ord(c) for c in ".,;:?"], 6] = 1
_CLASS[10, 7] = 1
_CODE = np.zeros(256, np.uint64)  # the same, packed: no class fills its field within a slice of 2**21 bytes
_PACK_A, _PACK_B = _CLASS[:, :3] @ (1 << np.array([0, 21, 42], np.int64)), _CLASS[:, 3:6] @ (1 << np.array([0, 21, 42], np.int64))
_PACK_C = _CLASS[:, 6:8] @ (1 << np.array([0, 21], np.int64)) + ((np.arange(256) == ord("|")).astype(np.int64) << 42)


def _class_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, 9))
    step = 1 << 20
    for a in range(0, len(buf), step):  # fields of 21 bits cannot overflow within a step
        b = min(len(buf), a + step)
        cut = np.clip(off, a, b) - a
        for k, pack in enumerate((_PACK_A, _PACK_B, _PACK_C)):
            c = np.zeros(b - a + 1, np.int64)
            np.cumsum(pack[buf[a:b]], out=c[1:])
            s = c[cut[1:]] - c[cut[:-1]]
            for f in range(3):
                out[:, 3 * k + f] += (s >> (21 * f)) & ((1 << 21) - 1)
    return out


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES a document."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    k = _class_counts(buf, off)
    s, e = word_bounds(buf, off)
    wb = np.searchsorted(s, off)
    nw = np.diff(wb).astype(float)
    h = span_hash(buf, s, e)
    doc = np.repeat(np.arange(n), np.diff(wb))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    chars = np.bincount(doc, e - s, n)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        run = np.diff(np.append(first, len(key)))
        of = (key[first] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(top, of, run)
    cap = np.bincount(doc, _CLASS[buf[s], 0], n) if len(s) else np.zeros(n)
    per = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    return np.column_stack([
        np.log1p(size), per(k[:, 0], k[:, 1]), per(k[:, 2], size), per(k[:, 3], size), per(k[:, 4], size), per(k[:, 5], size), per(chars, nw), per(distinct, nw),
        per(np.bincount(doc, same, n), nw), per(k[:, 6], nw), per(k[:, 7], nw), per(k[:, 8], nw), per(top, nw), per(cap, nw), np.log1p(nw),
    ])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, lam: float = 1.0) -> np.ndarray:
    """Newton values of a greedy tree of few leaves over ordered bins."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                x = gain(a, m) + gain(m, b) - gain(a, b)
                i = int(x.argmax())
                best = max(best, (float(x[i]), int(m[i])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def _cross(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-way histogram into four quadrants."""
    best, table = 0.0, np.zeros_like(g)
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    quads = []
    for c in (cg, ch):
        tl, t, left, all_ = c[i, j], c[i, m], c[n, j], c[n, m]
        quads.append((tl, t - tl, left - tl, all_ - t - left + tl))
    gain = sum(q**2 / (w + lam) for q, w in zip(*quads)) - cg[n, m] ** 2 / (ch[n, m] + lam)
    if gain.size:
        a, b = np.unravel_index(int(gain.argmax()), gain.shape)
        best = float(gain[a, b])
        v = [float(q[a, b] / (w[a, b] + lam)) for q, w in zip(*quads)]
        table[: a + 1, : b + 1], table[: a + 1, b + 1 :], table[a + 1 :, : b + 1], table[a + 1 :, b + 1 :] = v
    return best, table


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        good = float(y.mean()) if len(y) else 1.0
        if not 0 < good < 1:
            self.base = 10.0 if good else -10.0
            return
        self.base = float(np.log(good / (1 - good)))
        b = self.bins(x)
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-z))
                step = RATE * _tree(np.bincount(b[f], y - p, len(t)), np.bincount(b[f], p * (1 - p), len(t)))
                t += step
                z += step[b[f]]
        p = 1 / (1 + np.exp(-z))
        ranked = []
        for i in range(len(b)):
            for j in range(i):
                shape = (len(self.tables[i]), len(self.tables[j]))
                hist = [np.bincount(b[i] * shape[1] + b[j], w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p))]
                ranked.append((_cross(*hist)[0], i, j))
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for _, i, j in sorted(ranked)[::-1][:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-z))
                at = b[i] * t.shape[1] + b[j]
                step = RATE * _cross(*(np.bincount(at, w, t.size).reshape(t.shape) for w in (y - p, p * (1 - p))))[1]
                t += step
                z += step.ravel()[at]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[f]]
        for i, j, t in self.pairs:
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """Fit on at most `rows` labelled documents; two passes over documents' ids and one over the sampled texts."""
    spark = docs.sparkSession
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y_"))
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = {r.doc_id: r.y_ for r in sample.collect()}  # bounded by `rows`
    if not ids:
        return Gam(np.zeros((0, len(FEATURES))), np.zeros(0))
    known = spark.createDataFrame(list(ids.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y_ double")
    rows_ = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y_")

    def run(batches):
        for b in batches:
            x = _features_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c) for c in x.T)], ["doc_id", "y_", *FEATURES])

    got = rows_.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y_ double, " + ", ".join(f"{f} double" for f in FEATURES))
    got = got.groupBy("doc_id").agg(F.min(F.struct("y_", *FEATURES)).alias("f")).select("doc_id", "f.*").toPandas()  # a row a labelled id
    got = got.sort_values(list(got.columns))
    return Gam(got[list(FEATURES)].to_numpy(float), got["y_"].to_numpy(float))


def _features_of(col: pa.Array) -> np.ndarray:
    parts = [features(buf, off) for _, _, buf, off in texts(col)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, p_good, keep) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = shared.value.probability(_features_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= KEEP)], ["doc_id", "p_good", "keep"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, p_good double, keep boolean")


def kept(docs: DataFrame, model: Gam) -> DataFrame:
    """The rows of docs, all columns, that the model keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.probability(_features_of(b.column(at))) >= KEEP))

    return docs.mapInArrow(lean(run), docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
