"""Language-model scores from a Brown class bigram model.

Every word of the corpus has a class, and its emission is its own count over
that of its class:

1. Counts of all words; the EXCHANGE_WORDS most frequent are exchanged.
2. Counts of neighbouring pairs of units (the exchanged words, one unit for all
   others, one for the start of a text).  Exchange clustering on the driver moves
   each exchanged word, in order of frequency, to the class that most raises the
   likelihood of the class bigram model, until a sweep moves none or SWEEPS are done.
3. All other words, however many, are shuffled by word with the counts of their
   neighbours' classes; each goes to the class that these counts make most likely
   under the transitions of step 2.  The table of words and classes is on disk.
4. The table is joined with the corpus: the HEAD most frequent words are sent to
   all executors, any others join by shuffle, per block of documents.  What that
   gives, the classes of each text, is counted and scored.  HEAD decides only
   how words travel, not the result.

P(w | v) = P(class w | class v) * P(w | class w).  Transitions are interpolated
with class frequencies (DISCOUNT pseudo-counts).  A word that the model's corpus
has not counts as one seen once, in the class that has most of the words that
were not exchanged.

Log probabilities are held in units of 2**-16 bit as integers, so scores do not
depend on the order of addition.

Defined cases: null or wordless texts have 0 words and null perplexity; equal
counts are ordered by hash; every row is scored and counted, repeats too; an
empty corpus scores nothing; long texts are counted and scored whole; only doc_id
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import HashIndex, saved, segment_sum, texts, words

EXCHANGE_WORDS, CLASSES, SWEEPS, DISCOUNT = 1536, 48, 6, 4.0
#: Words sent to all executors; tokens of a block of documents that joins by shuffle; neighbour counts of a part of the words; of a batch sent from Python.
HEAD, BLOCK_TOKENS, PART_TOKENS, BATCH_ROWS = 1 << 18, 1 << 19, 1 << 21, 1 << 16
UNIT = 1 << 16


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, times) of all words of the corpus, by hash; counted within each task first."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            for _, _, buf, off in texts(b.column(0)):
                h, _ = words(buf, off)
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield _table(*held[0])
                        held, size = [], 0
        if held:
            yield _table(*_merge(held))

    src = docs.select(F.lower("text").alias("text")).where("text is not null")
    return src.mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def _merge(parts):
    key, n = (np.concatenate(x) for x in zip(*parts))
    key, of = np.unique(key, return_inverse=True)
    return key, np.bincount(of, n, len(key)).astype(np.int64)


def _table(key, n):
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "times"])


class Units:
    """Unit of each listed word: its rank; then one unit for all others and one for the start of a text."""

    def __init__(self, word: np.ndarray, others: int):
        self.index, self.words = HashIndex(word), len(word)
        self.rare, self.start, self.count = self.words, self.words + 1, self.words + 2
        self.types = np.array([float(others)])  # words that are not listed

    def of(self, h: np.ndarray) -> np.ndarray:
        at = self.index.get(h)
        return np.where(at >= 0, at, self.rare).astype(np.int64)


def _pairs(h: np.ndarray, bounds: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    u = units.of(h)
    before = np.empty_like(u)
    before[1:] = u[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = units.start
    return before, u


def pair_counts(docs: DataFrame, units: Units) -> np.ndarray:
    """Square table of neighbouring units over the whole corpus."""
    shared, n = docs.sparkSession.sparkContext.broadcast(units), units.count

    def count(batches):
        table = np.zeros(n * n, np.int64)
        for b in batches:
            for _, _, buf, off in texts(b.column(0)):
                x, y = _pairs(*words(buf, off), shared.value)
                key, c = np.unique(x * n + y, return_counts=True)
                table[key] += c
        key = np.flatnonzero(table)
        for i in range(0, len(key), 1 << 18):
            k = key[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(table[k])], ["pair", "times"])

    src = docs.select(F.lower("text").alias("text")).where("text is not null")
    got = src.mapInArrow(count, "pair int, times long").groupBy("pair").agg(F.sum("times").alias("times")).toArrow()
    table = np.zeros(n * n, np.int64)
    table[np.asarray(got["pair"])] = np.asarray(got["times"])
    return table.reshape(n, n)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray, of: np.ndarray) -> float:
    """The part of the log likelihood of the class bigram model that depends on the classes."""
    k = int(of.max()) + 1
    n = np.zeros((k, k))
    np.add.at(n, (of[:, None], of[None, :]), table)
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


def exchange(table: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: the first `movable` are clustered into `classes`, every other is a class of its own."""
    units = len(table)
    k = min(classes, movable)
    total = k + units - movable
    of = np.append(np.arange(movable) % max(k, 1), np.arange(k, total))
    t = table.astype(float)
    left, right = np.zeros((units, total)), np.zeros((units, total))  # counts of a unit before / after each class
    for u in range(units):
        left[:, of[u]] += t[:, u]
        right[:, of[u]] += t[u, :]
    n = np.zeros((total, total))
    np.add.at(n, of, left)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            old, loop = of[w], t[w, w]
            out, into = left[w].copy(), right[w].copy()
            out[old] -= loop
            into[old] -= loop
            n[old] -= out
            n[:, old] -= into
            n[old, old] -= loop
            row, col = n.sum(1) + into, n.sum(0) + out  # each class has its neighbours of w back, wherever w goes
            so, si = out.sum() + loop, into.sum() + loop
            a, b = n[:k] + out, n[:, :k] + into[:, None]
            gain = (_f(a) - _f(n[:k])).sum(1) + (_f(b) - _f(n[:, :k])).sum(0)
            own = np.arange(k)
            d = n[own, own]
            gain += _f(d + out[own] + into[own] + loop) - _f(d) - (_f(d + out[own]) - _f(d)) - (_f(d + into[own]) - _f(d))
            gain -= _f(row[:k] + so) - _f(row[:k]) + _f(col[:k] + si) - _f(col[:k])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            n[new] += out
            n[:, new] += into
            n[new, new] += loop
            if new != old:
                moved += 1
                of[w] = new
                left[:, old] -= t[:, w]
                left[:, new] += t[:, w]
                right[:, old] -= t[w]
                right[:, new] += t[w]
        if not moved:
            break
    return of


def _neighbours(docs: DataFrame, units: Units, of: np.ndarray, parts: int) -> DataFrame:
    """(part, word, code, times) of all words that are not units of their own, a range of hashes a part; a row has arrays of many
    words, as bytes: hash, the class before or the number of classes plus the class after, and times."""
    shared, k = docs.sparkSession.sparkContext.broadcast((units, of)), int(of.max()) + 1

    def table(held):  # empties `held`; of each column no more than two copies are in memory at once
        h, code, times = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((code, h))
        h = h[order]
        code = code[order]
        times = times[order]
        del order
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1]))) if len(h) else np.zeros(0, np.int64)
        return h[first], code[first], np.add.reduceat(times, first) if len(first) else times

    def out(merged):
        h, code, times = merged
        edges = np.searchsorted(h, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
        edges = np.concatenate([[0], edges, [len(h)]])
        full = np.flatnonzero(np.diff(edges))
        while len(full):
            m = max(int(np.searchsorted(edges[full + 1], edges[full[0]] + BATCH_ROWS, "right")), 1)
            cut = [slice(edges[i], edges[i + 1]) for i in full[:m]]
            cols = [pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (h, code, times)]
            yield pa.RecordBatch.from_arrays([pa.array(full[:m]), *cols], ["part", "word", "code", "times"])
            full = full[m:]

    def count(batches):
        units, of = shared.value
        held, size = [], 0
        for b in batches:
            for _, _, buf, off in texts(b.column(0)):
                h, bounds = words(buf, off)
                before, u = _pairs(h, bounds, units)
                rare = u == units.rare
                last = np.zeros(len(h), bool)
                last[bounds[1:][np.diff(bounds) > 0] - 1] = True
                follows = np.flatnonzero(rare & ~last)
                w = np.concatenate([h[rare], h[follows]])
                code = np.concatenate([of[before[rare]], k + of[u[np.minimum(follows + 1, len(u) - 1)]]]).astype(np.int16)
                held.append((w, code, np.ones(len(w), np.int64)))
                size += len(w)
                if size > 1 << 21:
                    held.append(table(held))
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from out(held.pop())
                        size = 0
        if held:
            yield from out(table(held))

    src = docs.select(F.lower("text").alias("text")).where("text is not null")
    return src.mapInArrow(count, "part long, word binary, code binary, times binary")


def nearest(left: np.ndarray, right: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """Class among the first `classes` that makes each word's neighbours most likely; left, right: counts of the classes before and after it."""
    column, row = np.log(n.sum(0)[:classes] + 1), np.log(n.sum(1)[:classes] + 1)
    gain = left @ np.log(n[:, :classes] + 0.5) - left.sum(1)[:, None] * column
    gain += right @ np.log(n[:classes] + 0.5).T - right.sum(1)[:, None] * row
    return np.round(gain, 6).argmax(1)


def word_classes(docs: DataFrame, units: Units, of: np.ndarray, n: np.ndarray, classes: int, tokens: int) -> DataFrame:
    """(word, class, times) of all words that are not units of their own."""
    k = len(n)

    def assign(part):
        h, code, times = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("word", np.uint64), ("code", np.int16), ("times", np.int64)))
        word, at = np.unique(h, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, code, times = at[order], code[order].astype(np.int64), times[order]
        to, seen = np.zeros(len(word), np.int16), np.zeros(len(word), np.int64)
        for i in range(0, len(word), 1 << 14):
            m = min(1 << 14, len(word) - i)
            a, b = np.searchsorted(at, [i, i + m])
            c = np.bincount((at[a:b] - i) * 2 * k + code[a:b], times[a:b], m * 2 * k).reshape(m, 2 * k)
            to[i : i + m], seen[i : i + m] = nearest(c[:, :k], c[:, k:], n, classes), c[:, :k].sum(1)
        return pa.table([pa.array(word.view(np.int64)), pa.array(to), pa.array(seen)], ["word", "class", "times"])

    return _neighbours(docs, units, of, 2 * tokens // PART_TOKENS + 4).groupBy("part").applyInArrow(assign, "word long, class short, times long")


def _bits(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(np.maximum(p, 1e-300)) * UNIT).astype(np.int64)


class BrownModel:
    """units and of: the words sent to all executors and their classes, after them those of a word never seen and of the start; rest: (word, class, times) of all other words."""

    def __init__(self, units: Units, of: np.ndarray, times: np.ndarray, inside: np.ndarray, rest: DataFrame | None, tokens: int):
        self.units, self.of, self.rest, self.tokens = units, of, rest, tokens
        self.inside = np.maximum(inside, 1.0)
        self.emit_bits = _bits(np.append(times, [1, 1]) / self.inside[of])

    def transitions(self, n: np.ndarray) -> None:
        k, start = len(n), self.of[self.units.start]
        share = (n.sum(0) + 1) * (np.arange(k) != start)
        share = share / max(share.sum(), 1)
        self.step_bits = _bits((n + DISCOUNT * share) / (n.sum(1, keepdims=True) + DISCOUNT))

    def classed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, emitted, classes) of every row: bits of the emissions; the class of each word, as bytes of 16-bit integers."""
        spark = docs.sparkSession
        kind = docs.schema["doc_id"].dataType.simpleString()
        shared = spark.sparkContext.broadcast((self.units, self.of, self.emit_bits, self.inside))
        result = f"doc_id {kind}, n_words long, emitted long, classes binary"

        def rows(ids, col, more=None):
            units, of, emit, inside = shared.value
            n, bits, classes = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64), []
            for i, j, buf, off in texts(col):
                h, bounds = words(buf, off)
                u = units.of(h)
                c, e = of[u], emit[u]
                if more:
                    at = more[0].get(h)
                    c, e = np.where(at >= 0, more[1][at], c), np.where(at >= 0, more[2][at], e)
                n[i:j], bits[i:j] = np.diff(bounds), segment_sum(e, bounds)
                raw = c.astype("<u2").tobytes()
                classes += [raw[2 * a : 2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            return [ids, pa.array(n), pa.array(bits), pa.array(classes, pa.binary())]

        names = ["doc_id", "n_words", "emitted", "classes"]
        src = docs.select("doc_id", F.lower("text").alias("text"))
        if self.rest is None:

            def run(batches):
                for b in batches:
                    yield pa.RecordBatch.from_arrays(rows(b.column(0), b.column(1)), names)

            return src.mapInArrow(run, result)

        def needed(batches):
            units = shared.value[0]
            for b in batches:
                block = np.asarray(b.column(0))
                for i, j, buf, off in texts(b.column(1)):
                    h, bounds = words(buf, off)
                    pos = np.flatnonzero(units.of(h) == units.rare)
                    h, at = h[pos], np.repeat(block[i:j], np.diff(bounds))[pos]
                    order = np.lexsort((h, at))
                    h, at = h[order], at[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])) if len(h) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(h[new].view(np.int64))], ["block", "word"])

        def join(left, right):
            text, need = left.combine_chunks(), right.combine_chunks()
            more = None
            if need.num_rows:
                h, first = np.unique(np.asarray(need["word"]).view(np.uint64), return_index=True)
                c, times = np.asarray(need["class"])[first].astype(np.int64), np.asarray(need["times"])[first]
                more = HashIndex(h), c, _bits(times / shared.value[3][c])
            parts = [pa.Table.from_arrays(rows(b.column("doc_id"), b.column("text"), more), names) for b in text.to_batches()]
            return pa.concat_tables(parts)

        blocks = self.tokens // BLOCK_TOKENS + 1
        keyed = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
        need = keyed.select("block", "text").mapInArrow(needed, "block long, word long").join(self.rest, "word").select("block", "word", "class", "times")
        return keyed.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(join, result)


def class_pairs(classed: DataFrame, k: int, start: int) -> np.ndarray:
    """Square table of neighbouring classes."""

    def count(batches):
        n = np.zeros(k * k, np.int64)
        for b in batches:
            c, before, _ = _sequence(b.column(0), start)
            n += np.bincount(before * k + c, minlength=k * k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "times"])

    got = classed.select("classes").mapInArrow(count, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times")).toArrow()
    n = np.zeros(k * k)
    n[np.asarray(got["pair"])] = np.asarray(got["times"])
    return n.reshape(k, k)


def _sequence(col: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all words, those before them, bounds of the rows)."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    c = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view("<u2").astype(np.int64) if raw is not None else np.zeros(0, np.int64)
    bounds = (off - off[0]) // 2
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = start
    return c, before, bounds


def fit(docs: DataFrame, exchange_words: int = EXCHANGE_WORDS, classes: int = CLASSES, head: int = HEAD) -> BrownModel:
    counts = saved(word_counts(docs), "words")
    types, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    top = counts.orderBy(F.desc("times"), "word").limit(exchange_words).toArrow()
    word, times = np.asarray(top["word"]), np.asarray(top["times"])
    order = np.lexsort((word, -times))
    word, times = word[order].view(np.uint64), times[order].astype(np.int64)
    units = Units(word, types - len(word))
    pairs = pair_counts(docs, units)
    of = exchange(pairs, units.words, classes)
    k = int(of.max()) + 1  # classes, then others, then the start
    n = np.zeros((k, k))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    inside = np.zeros(k - 1)
    np.add.at(inside, of[: len(word)], times)
    common, rest = 0, None
    to = of[: len(word)]
    if types > len(word):
        table = saved(word_classes(docs, units, of, n, k - 2, tokens), "classes")
        per = table.groupBy("class").agg(F.count(F.lit(1)).alias("words"), F.sum("times").alias("times")).orderBy(F.desc("words"), "class").collect()
        for r in per:
            inside[r["class"]] += r.times
        common = per[0]["class"]
        more = table.orderBy(F.desc("times"), "word").limit(max(head - len(word), 0)).toArrow()
        word = np.append(word, np.asarray(more["word"]).view(np.uint64))
        times, to = np.append(times, np.asarray(more["times"])), np.append(to, np.asarray(more["class"]).astype(np.int64))
        rest = table if types > len(word) else None
    start = max(k - 2, 1)  # no class of others is left
    model = BrownModel(Units(word, types - len(word)), np.append(to, [common, start]).astype(np.int64), times, np.append(inside[:start], 1) if k > 2 else np.ones(2), rest, tokens)
    model.fitted = saved(model.classed(docs), "classed")
    model.transitions(class_pairs(model.fitted, start + 1, start))
    return model


def perplexity(docs: DataFrame, model: BrownModel, classed: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, bits, perplexity) of every row; classed: model.classed(docs), if there already."""
    classed = model.classed(docs) if classed is None else classed
    shared = docs.sparkSession.sparkContext.broadcast((model.step_bits, int(model.of[model.units.start])))

    def run(batches):
        step, start = shared.value
        for b in batches:
            n = np.asarray(b.column(1))
            c, before, bounds = _sequence(b.column(3), start)
            bits = np.asarray(b.column(2)) + segment_sum(step[before, c], bounds)
            ppl = np.exp2(bits / UNIT / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits / UNIT), pa.array(ppl, mask=n == 0)], ["doc_id", "n_words", "bits", "perplexity"])

    return classed.mapInArrow(run, f"doc_id {classed.schema['doc_id'].dataType.simpleString()}, n_words long, bits double, perplexity double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return perplexity(docs, model, model.fitted)
