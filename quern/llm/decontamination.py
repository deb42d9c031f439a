"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: lower case, every run of other than
letters and digits one space.  An item of m bytes may differ by at most
k = floor(ERROR_RATE * m) edits from some stretch of a document.  Cut into k+1
pieces, one piece at least stands unchanged in that stretch; pieces are found by
looking up a hash of each position's next bytes, compared in full, and the
stretch around a hit is verified with Myers' bit-parallel distance (one big
integer a column, free start and end in the text).

Items go to the executors as a broadcast table of at most GROUP_BYTES of text;
a larger benchmark is split by item hash into groups, each matched in a pass of
its own, so no task ever holds more.

Defined cases: null or empty texts match nothing and null or blank items match
nothing; items too short for an error must stand as whole words; equal items are
reported under each id, repeated rows once (the result is distinct); long
texts are searched whole; an empty table on either side gives an empty result;
only doc_id/text and item_id/text are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import WORD, HashIndex, lean, mix, texts

ERROR_RATE = 0.05
GROUP_BYTES = 32 << 20
_WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16)


def normalise(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with other than word bytes turned to single spaces; each row has a space at both ends."""
    n = len(off) - 1
    out = np.full(len(buf) + 2 * n, 32, np.uint8)
    at = np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    word = WORD[buf]
    out[at[word]] = buf[word]
    ends = off + 2 * np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[ends[:-1]] = True
    total = np.append(0, np.cumsum(keep))
    return out[keep], total[ends]


def normalise_text(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    out, _ = normalise(raw, np.array([0, len(raw)]))
    return out.tobytes()


def myers(pattern: bytes, text: bytes, peq: dict[int, int] | None = None) -> int:
    """Least edit distance of pattern to any stretch of text."""
    m = len(pattern)
    if not m:
        return 0
    peq = peq or char_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


def char_masks(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _anchor(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes at each position; positions too near the end are left out."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)

    def load(at: int, w: int) -> np.ndarray:
        if w == 8:
            pad = np.append(buf[at : at + n + 7], np.zeros(8, np.uint8))
            out = np.empty(n + 8, np.uint64)
            for k in range(8):
                part = pad[k : k + (len(pad) - k) // 8 * 8].view(np.uint64)
                out[k : k + 8 * len(part) : 8][: len(part)] = part[: len(out[k : k + 8 * len(part) : 8])]
            return out[:n]
        key = np.zeros(n, np.uint64)
        for k in range(w):
            key |= buf[at + k : at + k + n].astype(np.uint64) << np.uint64(8 * k)
        return key

    if width <= 8:
        return mix(load(0, width))
    return mix(load(0, 8) * np.uint64(0x9E3779B97F4A7C15) + load(width - 8, 8))


class Matcher:
    """Pieces of a group of items, by the hash of their first bytes."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        self.items = []
        by_width: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for item_id, text in items:
            p = normalise_text(text)
            core = p.strip(b" ")
            if not core:
                continue
            k = int(rate * len(core))
            body = core if k else b" " + core + b" "
            cuts = [len(body) * i // (k + 1) for i in range(k + 2)]
            at = len(self.items)
            self.items.append((item_id, body, k, char_masks(body)))
            for a, b in zip(cuts, cuts[1:]):
                width = max(w for w in _WIDTHS if w <= b - a)
                by_width.setdefault(width, []).append((at, a, b - a, body[a:b]))
        self.widths = []
        for width, pieces in sorted(by_width.items()):
            h = np.array([_anchor(np.frombuffer(p[3], np.uint8), width)[0] for p in pieces], np.uint64)
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            ends = np.append(first[1:], len(h))
            bits = max(16, int(len(keys) * 64).bit_length())
            sieve = np.zeros(1 << bits, bool)
            sieve[keys >> np.uint64(64 - bits)] = True
            self.widths.append((width, np.uint64(64 - bits), sieve, HashIndex(keys), first, ends, [pieces[i] for i in order]))

    def match(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, object, int]]:
        """(row, item id, distance) of all items within their budget in the normalised rows."""
        raw = buf.tobytes()
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for width, shift, sieve, index, first, ends, pieces in self.widths:
            h = _anchor(buf, width)
            pos = np.flatnonzero(sieve[h >> shift])
            found = index.get(h[pos])
            pos, found = pos[found >= 0], found[found >= 0]
            rows = np.searchsorted(off, pos, "right") - 1
            for t, f, row in zip(pos.tolist(), found.tolist(), rows.tolist()):
                low, high = int(off[row]), int(off[row + 1])
                for item, a, size, piece in pieces[first[f] : ends[f]]:
                    if t + size <= high and raw.startswith(piece, t):
                        _, body, k, _ = self.items[item]
                        windows.setdefault((row, item), []).append((max(low, t - a - k), min(high, t - a + len(body) + k)))
        out = []
        for (row, item), spans in windows.items():
            item_id, body, k, masks = self.items[item]
            best, done = k + 1, -1
            spans = sorted(set(spans))
            for a, b in spans:  # an exact copy settles it
                if raw.find(body, a, b) >= 0:
                    best = 0
                    break
            else:
                if k:
                    for a, b in spans:
                        a = max(a, done - len(body) - 2 * k) if done > a else a
                        if b > done:
                            best = min(best, myers(body, raw[a:b], masks))
                            done = b
            if best <= k:
                out.append((row, item_id, best))
        return out


def _groups(items: DataFrame, limit: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == g) if n > 1 else items for g in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, limit: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every document that holds an item within its error budget, with the least distance."""
    spark = docs.sparkSession
    doc, item = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc}, item_id {item}, distance int"
    src = docs.select("doc_id", F.lower("text").alias("text"))
    out = None
    for group in _groups(items.select("item_id", "text").where("text is not null"), limit):
        matcher = Matcher([(r.item_id, r.text) for r in group.distinct().collect()], rate)  # at most `limit` bytes
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            kind = None
            for b in batches:
                rows, ids, dist = [], [], []
                for i, _, buf, off in texts(b.column(1)):
                    for row, item_id, d in shared.value.match(*normalise(buf, off)):
                        rows.append(i + row), ids.append(item_id), dist.append(d)
                if rows:
                    kind = kind or (pa.string() if item == "string" else pa.int32() if item == "int" else pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ids, kind), pa.array(dist, pa.int32())], ["doc_id", "item_id", "distance"])

        part = src.mapInArrow(lean(run), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, limit: int = GROUP_BYTES) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item: each row is judged where it stands, without a join."""
    spark, schema, width = docs.sparkSession, docs.schema, len(docs.columns)
    for group in _groups(items.select("item_id", "text").where("text is not null"), limit):
        shared = spark.sparkContext.broadcast(Matcher([(r.item_id, r.text) for r in group.distinct().collect()], rate))

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _, buf, off in texts(b.column(width)):
                    keep[[i + row for row, _, _ in shared.value.match(*normalise(buf, off))]] = False
                yield pa.RecordBatch.from_arrays(b.columns[:width], schema=pa.schema(list(b.schema)[:width])).filter(pa.array(keep))

        lowered = docs.select(*(docs[c] for c in docs.columns), F.lower("text").alias("".join(docs.columns) + "_low"))
        docs = lowered.mapInArrow(lean(run), schema)
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
