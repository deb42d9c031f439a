"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0..`order` with escape method C
(no exclusions): in a context seen n times with d distinct successors, a seen
byte costs log2((n+d)/count) bits and an escape log2((n+d)/d) bits; a context
never seen is passed to the next shorter one free of charge; below order 0
stands the uniform distribution over 256 bytes.  Statistics are frozen after
training, so a byte's cost depends only on the `order` bytes before it, and the
trees of all languages fold into one table per order from (context, byte) to
the exact code lengths under every language.  Code lengths are held in units of
2**-12 bit as integers: totals do not depend on the order of addition.

Defined cases: a null or empty text has language NULL and 0 bits; long texts are
scored whole, in blocks, and take part in training by pieces; of equally cheap
languages the first in byte order wins; rows are scored independently, so
repeated rows and clashing extra columns do not matter (only id, text and, for
training, lang are read); with no training rows every language is NULL; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import HashIndex, segment_sum, texts

UNIT = 4096
ORDER = 4
#: Bounds of the training sample: pieces of labelled texts of each language, characters of a piece.  Bytes scored at once.
TRAIN_PIECES, PIECE, BLOCK = 250, 1 << 15, 1 << 19


def training_sample(docs: DataFrame, per_lang: int = TRAIN_PIECES, piece: int = PIECE) -> list[tuple[str, str]]:
    """(lang, text) of at most per_lang pieces a language, those with the least hashes of id and number; texts are cut into pieces, so long ones take part as they are long."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(char_length(text) - 1) div {piece}")))
    key = F.struct(F.xxhash64("doc_id", "number").alias("h"), "doc_id", "number")
    keyed = labelled.withColumn("number", number).select("lang", key.alias("k"), "text", "number")
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("k"))
    cut = keyed.select("lang", "k").withColumn("r", rank).where(F.col("r") <= per_lang).groupBy("lang").agg(F.max("k").alias("cut"))
    chosen = keyed.join(F.broadcast(cut), "lang").where(F.col("k") <= F.col("cut"))  # one row a language is sent
    rows = chosen.select("lang", "k", F.expr(f"substring(text, cast(number * {piece} + 1 as int), {piece})").alias("part")).dropDuplicates(["lang", "k", "part"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k", "part"))
    got = rows.withColumn("r", rank).where(F.col("r") <= per_lang).collect()  # repeated ids do not widen the bound
    return [(r.lang, r.part) for r in sorted(got, key=lambda r: (r.lang, r.r))]


class PpmModel:
    """Code lengths of all languages: for each order a table by (context, byte) and one of escapes by context."""

    def __init__(self, sample: list[tuple[str, str]], order: int = ORDER):
        if not 0 <= order <= 6:
            raise ValueError("order must lie between 0 and 6")
        self.order, self.langs = order, sorted({lang for lang, _ in sample})
        n = len(self.langs)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            docs = [np.frombuffer(t.encode(), np.uint8) for x, t in sample if x == lang]
            buf = np.concatenate(docs)
            off = np.cumsum([0, *map(len, docs)])
            pos = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
            counts.append([np.unique(_keys(buf, k)[pos >= k], return_counts=True) for k in range(order + 1)])
        self.grams, self.cost, self.ctx, self.esc = [], [], [], []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counts])) if n else np.zeros(0, np.uint64)
            ctxs = np.unique(keys >> np.uint64(8))
            cost = np.empty((len(keys), n), np.int32)
            esc = np.zeros((len(ctxs), n), np.int32)
            for j in range(n):
                g, c = counts[j][k]
                own, first = np.unique(g >> np.uint64(8), return_index=True)
                total = np.add.reduceat(c, first) if len(c) else c
                kinds = np.diff(np.append(first, len(g)))
                e = np.rint(np.log2((total + kinds) / kinds) * UNIT).astype(np.int32)
                esc[np.searchsorted(ctxs, own), j] = e
                shorter = self._back(k, keys)[:, j]
                cost[:, j] = shorter + esc[np.searchsorted(ctxs, keys >> np.uint64(8)), j]
                of = np.searchsorted(own, g >> np.uint64(8))
                cost[np.searchsorted(keys, g), j] = np.rint(np.log2((total + kinds)[of] / c) * UNIT)
            self.grams.append(HashIndex(keys))
            self.cost.append(cost)
            self.ctx.append(HashIndex(ctxs))
            self.esc.append(esc)

    def _back(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Costs of the last bytes of order-k keys under the next shorter context."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8 * UNIT, np.int32)
        return self.lookup(k - 1, keys & np.uint64((1 << (8 * k)) - 1))

    def lookup(self, k: int, keys: np.ndarray) -> np.ndarray:
        at = self.grams[k].get(keys)
        out = self.cost[k][at] if len(self.cost[k]) else np.zeros((len(keys), len(self.langs)), np.int32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            m = keys[missing]
            c = self.ctx[k].get(m >> np.uint64(8))
            fee = self.esc[k][c] * (c >= 0)[:, None] if len(self.esc[k]) else 0
            out[missing] = self._back(k, m) + fee
        return out

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Total cost of each document under each language, in 1/UNIT bit."""
        total = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        for a in range(0, len(buf), BLOCK):  # a long text is scored in blocks, each with the bytes before it
            b, back = min(a + BLOCK, len(buf)), min(a, self.order)
            part = buf[a - back : b]
            out = self.lookup(self.order, _keys(part, self.order)[back:])
            starts, ends = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
            for k in range(self.order):
                at = starts + k
                at = at[(at < ends) & (at >= a) & (at < b)] - a
                if len(at):
                    out[at] = self.lookup(k, _keys(part, k)[back:][at])
            total += segment_sum(out, np.clip(off, a, b) - a)
        return total


def _keys(buf: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each byte, and the byte, as one number; positions below k in buf hold fewer."""
    key = buf.astype(np.uint64)
    for j in range(1, k + 1):
        key[j:] |= buf[:-j].astype(np.uint64) << np.uint64(8 * j)
    return key


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """(doc_id, ppm_lang, ppm_bits, margin_bits): the cheapest language, its code length, and how much dearer the next one is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, None], object)
        for b in batches:
            n = b.num_rows
            best, bits, margin = np.full(n, len(m.langs)), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j, buf, off in texts(b.column(1), BLOCK):
                if not m.langs:
                    break
                cost = m.score(buf, off)
                ok = np.diff(off) > 0
                first = cost.argmin(1)
                low = cost[np.arange(j - i), first]
                best[i:j] = np.where(ok, first, len(m.langs))
                bits[i:j] = low
                if len(m.langs) > 1:
                    margin[i:j] = np.partition(cost, 1, axis=1)[:, 1] - low
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names[best], pa.string()), pa.array(bits / UNIT), pa.array(margin / UNIT)],
                ["doc_id", "ppm_lang", "ppm_bits", "margin_bits"],
            )

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ppm_lang string, ppm_bits double, margin_bits double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, f"{sf_dir}/documents.parquet")
    return identify(docs, PpmModel(training_sample(docs)))
