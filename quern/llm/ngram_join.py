"""Exact set-similarity join of documents on word n-grams.

A document is the set of its word n-grams (lower case; fewer words than n make
one gram; no words, the empty set, which matches nothing).  Production loses no
pair: all grams have one order, grams that a sample of the documents shows to be
common last, the others by hash.  Two sets r, s, |r| <= |s|, of Jaccard >= t have
at least t/(1+t) * (|r|+|s|) grams in common, the first k of which stand so early
in both that r finds them among its first |r| - ceil(2t/(1+t) * |r|) + k grams and s
among its first |s| - ceil(t * |s|) + k.  Each set is therefore listed under these
grams with their positions; sets of one gram meet there if their sizes allow the
threshold and what stands behind the gram in both can still reach it.  Pairs that
meet k times (or as often as they have grams in common at the threshold, if that is
less) are candidates.  k grows with the smaller set, as do chance meetings.  Which grams the sample finds common alters the work, never the result.

With recall < 1 (no query asks for it) sets meet in a universe partition instead,
and pairs may be lost.  Similar sets differ in at
most H = floor((1-t)/(1+t) * (|r|+|s|)) tokens.  Sizes fall into bands; in band b
the token universe is hashed into m segments.  If every segment i of r is given an
allowance a_i in {-1, 0, 1} with sum(a_i + 1) >= H + 1, some segment has
|r_i ^ s_i| <= a_i (pigeonhole): it is skipped at -1, compared as a whole at 0,
and within one deletion at 1.  Each set is indexed in its own band under its whole
segments and, in a fixed reserve of segments of every band, under their
one-deletion neighbourhoods; it probes its own band and, where its partners may
lie there, the next smaller one.  Allowances are dealt by cost: neighbourhoods that
buy more recall a key than whole segments first, then whole segments, largest
contents first (larger contents are rarer), contents known to be common last of
all.  m is only as large as it must be for a pair at the threshold to leave some
segment unchanged with that probability, and each probe stops when the chance that
all its segments differ by more than they are allowed is below 1 - recall, or at
H + 1.  A set with too few filled segments for either may miss pairs.

Equal sets are found first and stand under the least doc_id that has them; only
one text of each is indexed.  Candidates are verified on the full sets, in blocks.
A bucket of more than BUCKET sets is dealt to pairs of blocks.  The result has one
row a document: its id, the id of its class (the least of all documents linked to
it, directly or through others) and its links (the number of other documents
similar to it, copies included).

Defined cases: null and wordless texts are classes of their own without links;
null ids are left out; rows that repeat an id count as one document, whose set is
the one of the least hash; texts are hashed whole, however long; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import HashIndex, drop, forest, join_groups, lean, mix, ngrams, saved, texts, words
from .groups import components

N, THRESHOLD, RATIO, RECALL = 2, 0.6, 2.0, 1.0
#: Segments of a band whose neighbourhoods are indexed; sets of a bucket that meet in one task; share of the sampled index rows that makes a key common.
RESERVE, BUCKET, COMMON, SAMPLED = 3, 2048, 1e-5, 64
INDEX, PROBE = 1, 2
#: One in so many documents tells which grams are common; at least so many of them hold a common gram; at most so many grams are sent to the tasks.
ORDERED, SEEN, RANKED = 16, 2, 1 << 20
#: Grams of the sets whose listed rows meet in one task, at most about; listed rows that a task packs at once.
PART_GRAMS, PACKED_ROWS = 1 << 21, 1 << 17


class Bands:
    """Size bands, with the number of segments and of reserve segments of each."""

    def __init__(self, t: float = THRESHOLD, ratio: float = RATIO, recall: float = RECALL):
        if not 0 < t < 1 or ratio * t < 1:
            raise ValueError("needs 0 < threshold < 1 and a ratio of 1/threshold at least")
        self.t, self.c = t, (1 - t) / (1 + t)
        self.weight = np.inf if recall >= 1 else -np.log(1 - recall)
        lo, los, his = 1, [], []
        while lo < 1 << 40:
            hi = max(lo, int(lo * ratio))
            los.append(lo), his.append(hi)
            lo = hi + 1
        self.lo, self.hi = np.array(los, np.int64), np.array(his, np.int64)
        need = self.budget(self.hi, np.floor(self.hi / t + 1e-9).astype(np.int64)) + 1
        likely = need.copy()
        if recall < 1:
            for i, h in enumerate(need - 1):
                low, high = 1, int(need[i])
                while low < high:  # least m with (1 - exp(-h/m))**m <= 1 - recall
                    m = (low + high) // 2
                    low, high = (low, m) if -m * np.log1p(-np.exp(-h / m)) >= self.weight else (m + 1, high)
                likely[i] = low
        self.m = likely + np.where(need > 1, 2 + likely // 8, 0)
        self.reserve = np.where(need > 1, np.minimum(self.m, 3 + need // 64 if recall >= 1 else RESERVE), 0)

    def budget(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.floor(self.c * (a + b) + 1e-9).astype(np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, size, "right") - 1


def token_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes in order, document of each), documents in order."""
    g, doc = ngrams(*words(buf, off), n)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def set_keys(g: np.ndarray, doc: np.ndarray, n: int, salt: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each set, its size); an empty set has hash 0."""
    size = np.bincount(doc, minlength=n).astype(np.int64)
    c = np.append(np.uint64(0), np.cumsum(mix(g ^ np.uint64(salt))))
    ends = np.cumsum(size)
    return np.where(size > 0, mix(c[ends] - c[ends - size] + size.astype(np.uint64)), np.uint64(0)), size


def signatures(g: np.ndarray, doc: np.ndarray, size: np.ndarray, bands: Bands, common: HashIndex | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, kind) of all index and probe rows; common: keys that very many sets have."""
    keys, docs, kinds = [], [], []

    def put(k, d, kind):
        if len(k):
            keys.append(k), docs.append(d), kinds.append(np.broadcast_to(np.int8(kind), len(k)) if np.isscalar(kind) else kind)

    band = bands.of(np.maximum(size, 1))
    for step in (0, 1):
        b = band - step
        use = (size > 0) & (b >= 0) & ((step == 0) | (np.ceil(bands.t * size - 1e-9) <= bands.hi[b]))
        tok = np.flatnonzero(use[doc])
        if not len(tok):
            continue
        d, t = doc[tok], g[tok]
        m = bands.m[b[d]]
        seg = ((mix(t ^ (b[d].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(33)).astype(np.int64)) % m
        order = np.lexsort((seg, d))
        d, t, seg, m = d[order], t[order], seg[order], m[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])))
        count = np.diff(np.append(first, len(d)))
        w = mix(t ^ np.uint64(0xA0761D6478BD642F))
        total = np.add.reduceat(w, first)
        sd, ss = d[first], seg[first]
        sb = b[sd]
        tag = mix((sb.astype(np.uint64) << np.uint64(40)) ^ ss.astype(np.uint64))
        exact = mix(total ^ tag)
        other = np.uint64(0xE7037ED1A0B428DB)
        partner = np.minimum(bands.hi[b], np.floor(size / bands.t + 1e-9).astype(np.int64))
        most = bands.budget(size, partner)
        filled = np.bincount(sd, minlength=len(size))
        start = np.cumsum(filled) - filled
        half = most / 2
        lost, gained = (half / np.maximum(size, 1))[sd], (half / np.maximum(bands.m[b], 1))[sd]
        same = np.clip((1 - lost) ** count * np.exp(-gained), 0, 1 - 1e-12)
        near = np.clip(same * (1 + count * lost / np.maximum(1 - lost, 1e-12) + gained), 0, 1 - 1e-12)
        sure, surer = -np.log1p(-same), -np.log1p(-near)
        hot = common.get(exact) >= 0 if common is not None else np.zeros(len(exact), bool)
        in_reserve = ss < bands.reserve[sb]
        if bands.weight < np.inf:  # neighbourhoods that buy more a key than whole segments
            wide = in_reserve & (count >= 2) & ~hot & (surer > sure * (2 + count))
            sure = np.where(wide, surer, sure)
        else:
            wide = np.zeros(len(sd), bool)
        # then the largest contents, common ones last, up to H + 1 of them or to the recall
        by = np.lexsort((exact, -count, ~wide, hot, sd))
        rank = np.empty(len(sd), np.int64)
        rank[by] = np.arange(len(sd)) - start[sd[by]]
        c = np.append(0, np.cumsum(sure[by]))
        before = np.empty(len(sd))
        before[by] = c[:-1] - c[start[sd[by]]]
        probe = (rank < (most + 1)[sd]) & (before < bands.weight)
        wide &= probe
        enough = (filled > most) | (c[start + filled] - c[start] >= bands.weight)
        own = step == 0
        put(exact, sd, np.where(probe, PROBE, 0).astype(np.int8) + np.int8(INDEX if own else 0)) if own else put(exact[probe], sd[probe], PROBE)
        of_token = np.repeat(np.arange(len(first)), count)
        part = in_reserve[of_token]
        owner = of_token[part]
        if own and len(owner):
            put(mix(mix((total[owner] - w[part]) ^ tag[owner]) ^ other), sd[owner], INDEX)
        short = np.where(enough, 0, most + 1 - filled)  # so many segments need an allowance of 1
        if (short > 0).any():
            able = in_reserve & (count >= 2) & (short[sd] > 0) & ~wide
            at = np.flatnonzero(able)
            at = at[np.lexsort((exact[at], -count[at], sd[at]))]
            nth = np.arange(len(at)) - np.searchsorted(sd[at], sd[at], "left")
            at = at[nth < (short - np.bincount(sd[wide], minlength=len(size)))[sd[at]]]
            wide[at] = True
        put(mix(exact[wide] ^ other), sd[wide], PROBE)  # s has a token more
        part = wide[of_token]
        owner = of_token[part]
        put(mix((total[owner] - w[part]) ^ tag[owner]), sd[owner], PROBE)  # or one less
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(kinds)


def shared(sizes: np.ndarray, t: float) -> np.ndarray:
    """Least number of grams in common of two sets of Jaccard >= t whose sizes have this sum."""
    return np.ceil(t / (1 + t) * sizes * (1 - 1e-12) - 1e-9).astype(np.int64)


def meetings(size: np.ndarray) -> np.ndarray:
    """How often similar sets of this and a larger size meet at least, if they have so many grams in common."""
    return 4 + size // 32


def indexed(size: np.ndarray, at: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of this size are listed at this position for partners of their size or more."""
    return at <= size - shared(2 * size, t) + meetings(size) - 1


def prefixes(g: np.ndarray, doc: np.ndarray, size: np.ndarray, t: float, common: HashIndex | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, document, kind, position) of the grams under which sets are listed; INDEX: those for partners of its size or more; common: grams that go last, the commonest at the end."""
    if common is not None:
        rank = common.get(g)
        late = np.flatnonzero(rank >= 0)
        order = np.lexsort((np.arange(len(g)), np.where(rank >= 0, rank, -1), doc)) if len(late) else slice(None)
        g = g[order]
    start = np.cumsum(size) - size
    at = np.arange(len(g)) - start[doc]
    least = np.ceil(t * size * (1 - 1e-12) - 1e-9).astype(np.int64)  # a smaller partner lies in it but for the rest
    use = at <= (size - least + meetings(size) - 1)[doc]
    g, doc, at = g[use], doc[use], at[use]
    return g, doc, np.where(indexed(size[doc], at, t), INDEX | PROBE, PROBE).astype(np.int8), at


#: Sets of up to so many tokens carry a sketch: the parities of 128 hash classes of tokens, which cannot differ in more
#: places than the sets differ in tokens.  It spares small sets, whose segments say little, most chance candidates.
SKETCHED = 128


def parities(g: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit words of parities a set; 0 for empty and larger ones."""
    out = np.zeros((2, len(size)), np.uint64)
    small = (size <= SKETCHED)[doc]
    g, doc = g[small], doc[small]
    if len(g):
        cls = (mix(g ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(57)).astype(np.int64)
        bit = np.uint64(1) << (cls & 63).astype(np.uint64)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for k in (0, 1):
            out[k, doc[first]] = np.bitwise_xor.reduceat(np.where(cls >> 6 == k, bit, np.uint64(0)), first)
    return out


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc, h, h2, size) of every id: the hashes of its set, and its size."""

    def run(batches):
        for b in batches:
            for i, j, buf, off in texts(b.column(1)):
                g, doc = token_sets(buf, off, n)
                h, size = set_keys(g, doc, j - i)
                h2, _ = set_keys(g, doc, j - i, 0x2B7E151628AED2A6)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(h.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(size.astype(np.int32))], ["doc", "h", "h2", "size"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.lower("text").alias("text")).where("doc is not null")
    sets = src.mapInArrow(lean(run), "doc long, h long, h2 int, size int")
    return sets.groupBy("doc").agg(F.min(F.struct("h", "h2", "size")).alias("s")).select("doc", "s.*")


def _rows(docs: DataFrame, bands: Bands, n: int, common: HashIndex | None = None) -> DataFrame:
    """Index and probe rows of docs (doc, text) in the universe partition."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for i, j, buf, off in texts(b.column(1)):
                g, doc = token_sets(buf, off, n)
                _, size = set_keys(g, doc, j - i)
                key, d, kind = signatures(g, doc, size, bands, common)
                sketch = parities(g, doc, size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.zeros(len(d), np.int32)), pa.array(ids[i:j][d]), pa.array(size[d].astype(np.int32)), pa.array(kind), pa.array(sketch[0][d]), pa.array(sketch[1][d])], _ROW
                )

    return docs.mapInArrow(lean(run), _ROW_SCHEMA)


_ROW, _ROW_SCHEMA = ["key", "at", "doc", "size", "kind", "s0", "s1"], "key long, at int, doc long, size int, kind byte, s0 long, s1 long"


def _listed(docs: DataFrame, t: float, n: int, common: HashIndex | None, parts: int) -> DataFrame:
    """Documents of docs (doc, text) under the grams of `prefixes`, packed by parts of the grams: a row has arrays, as bytes, of grams
    and positions, and of the documents to which these belong in turn, with their sizes and numbers of grams."""

    def packed(held):
        key, at, doc, size = (np.concatenate(x) for x in zip(*held))
        part = ((mix(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        key, at, doc, size, part = (x[order] for x in (key, at, doc, size, part))
        run = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (part, doc, size)])))  # an id may have several sets
        times = np.diff(np.append(run, len(key))).astype(np.int32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        doc, size, part = doc[run], size[run], part[first]
        rows, runs = np.append(first, len(key)), np.append(np.searchsorted(run, first), len(run))
        cols = [pa.array([x[e[k] : e[k + 1]].tobytes() for k in range(len(first))], pa.binary()) for x, e in ((key, rows), (at, rows), (doc, runs), (size, runs), (times, runs))]
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *cols], _PACKED)

    def run(batches):
        held, count = [], 0
        for b in batches:
            ids = np.asarray(b.column(0))
            for i, j, buf, off in texts(b.column(1)):
                g, doc = token_sets(buf, off, n)
                size = np.bincount(doc, minlength=j - i).astype(np.int64)
                key, d, _, at = prefixes(g, doc, size, t, common)
                if len(key):
                    held.append((key, at.astype(np.int32), ids[i:j][d], size[d].astype(np.int32)))
                    count += len(key)
                if count >= PACKED_ROWS:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    return docs.mapInArrow(lean(run), _PACKED_SCHEMA)


_PACKED, _PACKED_SCHEMA = ["part", "key", "at", "doc", "size", "times"], "part int, key binary, at binary, doc binary, size binary, times binary"


def _ranks(docs: DataFrame, n: int) -> HashIndex | None:
    """The commonest grams of a sample of the documents, by rising number of its documents that hold them."""

    def run(batches):
        for b in batches:
            for _, _, buf, off in texts(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(token_sets(buf, off, n)[0].view(np.int64))], ["gram"])

    sample = docs.where(F.pmod(F.xxhash64("doc"), F.lit(ORDERED)) == 0).mapInArrow(lean(run), "gram long")
    counts = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    top = counts.orderBy(F.col("n").desc(), "gram").limit(RANKED).toArrow()
    keys = np.asarray(top["gram"].combine_chunks() if top.num_rows else np.zeros(0, np.int64))[::-1]
    return HashIndex(keys.view(np.uint64)) if len(keys) else None


def _common(docs: DataFrame, bands: Bands, n: int) -> HashIndex | None:
    """Keys that hold more than the share COMMON of the index rows of a sample (so at most 1 / COMMON keys)."""
    sample = _rows(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0), bands, n).where(F.col("kind").bitwiseAND(INDEX) > 0)
    counts = saved(sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    keys = [r.key for r in counts.where(F.col("n") >= max(8, int(COMMON * total))).select("key").collect()]
    drop(counts)
    return HashIndex(np.array(keys, np.int64).view(np.uint64)) if keys else None


#: Sum of the meetings that make a pair a candidate.
FULL = 240
LISTED = np.dtype([("doc", np.int64), ("size", np.int32), ("at", np.int32), ("flags", np.int8)])
MEMBER = np.dtype([*LISTED.descr, ("s0", np.uint64), ("s1", np.uint64)])


class _Members:
    """Columns of the members of buckets; listed ones have no sketches."""

    def __init__(self, who: np.ndarray):
        self.doc, self.size, self.at = (np.ascontiguousarray(who[c]) for c in ("doc", "size", "at"))
        self.s0, self.s1 = (np.ascontiguousarray(who[c]) if c in who.dtype.names else None for c in ("s0", "s1"))
        self.probe, self.index = (who["flags"] & PROBE) > 0, (who["flags"] & INDEX) > 0

    def fit(self, x: np.ndarray, y: np.ndarray, t: float, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of those of the pairs (x, y) of members of one bucket that can be similar, and what part of FULL the meeting is."""
        lo, hi = np.minimum(self.size[x], self.size[y]).astype(np.int64), np.maximum(self.size[x], self.size[y]).astype(np.int64)
        ok = ((self.probe[x] & self.index[y]) | (self.probe[y] & self.index[x])) & (self.doc[x] != self.doc[y])
        need = shared(lo + hi, t)
        times = np.minimum(meetings(lo), need) if exact else np.ones(len(lo), np.int64)
        # the gram and all that follows in both; at 0 it asks for sizes that allow the threshold
        ok &= (lo >= need) & (np.minimum(self.size[x] - self.at[x], self.size[y] - self.at[y]) > need - times)
        x, y, lo, hi, times = x[ok], y[ok], lo[ok], hi[ok], times[ok]
        if self.s0 is not None:
            apart = np.bitwise_count(self.s0[x] ^ self.s0[y]).astype(np.int64) + np.bitwise_count(self.s1[x] ^ self.s1[y])
            ok = (hi > SKETCHED) | (apart <= np.floor((1 - t) / (1 + t) * (lo + hi) + 1e-9))
            x, y, times = x[ok], y[ok], times[ok]
        return self.doc[x], self.doc[y], -(-FULL // times)


def _spans(first: np.ndarray, last: np.ndarray, x: np.ndarray, room: int = 1 << 18):
    """(x, y) for y in [first, last) of each x, in pieces of about `room` pairs."""
    n = np.maximum(last - first, 0)
    c = np.cumsum(n)
    at = 0
    while at < len(x):
        e = max(int(np.searchsorted(c, (c[at - 1] if at else 0) + room, "right")), at + 1)
        k = n[at:e]
        inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(x[at:e], k), np.repeat(first[at:e], k) + inner
        at = e


class _Found:
    """Distinct pairs of ids, least first, and their meetings, FULL at most."""

    def __init__(self):
        self.parts, self.held, self.room = [], 0, 4 << 20

    def add(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        p = np.empty(len(a), PAIR)
        p["a"], p["b"], p["w"] = np.minimum(a, b), np.maximum(a, b), w
        self.parts.append(p)
        self.held += len(p)
        if self.held > self.room:
            self.parts = [self.pairs()]
            self.held = len(self.parts[0])
            self.room = max(self.room, 2 * self.held)

    def pairs(self) -> np.ndarray:
        p = np.concatenate(self.parts) if self.parts else np.zeros(0, PAIR)
        p = p[np.lexsort((p["b"], p["a"]))]
        if not len(p):
            return p
        first = np.flatnonzero(np.append(True, (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])))
        w = np.minimum(np.add.reduceat(p["w"].astype(np.int64), first), FULL)
        p = p[first]
        p["w"] = w
        return p

    def batches(self):
        """(a, n, bs, ws, blk, of): the greater ids of the pairs of each lesser one, and their meetings."""
        p = self.pairs()
        if not len(p):
            return
        first = np.flatnonzero(np.append(True, p["a"][1:] != p["a"][:-1]))
        ends = np.append(first[1:], len(p))
        for k in range(0, len(first), 4096):
            blobs = [pack(p["b"][i:j]) for i, j in zip(first[k : k + 4096], ends[k : k + 4096])]
            times = [p["w"][i:j].tobytes() for i, j in zip(first[k : k + 4096], ends[k : k + 4096])]
            none = pa.array(np.zeros(len(blobs), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(p["a"][first[k : k + 4096]]), pa.array((ends - first)[k : k + 4096].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(times, pa.binary()), none, none], _MET)


PAIR = np.dtype([("a", np.int64), ("b", np.int64), ("w", np.uint8)])
_MET = ["a", "n", "bs", "ws", "blk", "of"]
_MET_SCHEMA = "a long, n int, bs binary, ws binary, blk int, of int"
_MET_TYPE = pa.schema([("a", pa.int64()), ("n", pa.int32()), ("bs", pa.binary()), ("ws", pa.binary()), ("blk", pa.int32()), ("of", pa.int32())])


def _near_sizes(size: np.ndarray, bucket: np.ndarray, t: float) -> np.ndarray:
    """End of the members of each one's bucket that are not too large for it; buckets in order, sizes in order within."""
    wide = np.int64(1 << 32)
    return np.searchsorted(bucket * wide + size, bucket * wide + np.floor(size / t * (1 + 1e-12) + 1e-9).astype(np.int64), "right")


def _accompanied(key: np.ndarray) -> np.ndarray:
    """Places of the keys that are there more than once; others wait in vain."""
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    return order[np.append(again, False) | np.append(False, again)] if len(key) else order


def _columns(batches) -> dict[str, np.ndarray]:
    """Columns of the rows of `_rows` that share their keys."""
    parts = [[np.asarray(b.column(c)) for c in range(7)] for b in batches]
    x = dict(zip(_ROW, (np.concatenate(c) for c in zip(*parts)))) if parts else {"key": np.zeros(0, np.int64)}
    del parts
    order = _accompanied(x["key"])
    return {c: v[order] for c, v in x.items()}


def _unpacked(batches, t: float) -> dict[str, np.ndarray]:
    """Columns of the rows packed by `_listed` that share their grams."""
    held = [b for b in batches if b.num_rows]
    column = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for b in held for x in b.column(_PACKED.index(c))), kind)
    order = _accompanied(key := column("key", np.int64))
    x = {"key": key[order], "at": column("at", np.int32)[order]}
    times = column("times", np.int32)
    of = np.repeat(np.arange(len(times), dtype=np.int32), times)[order]
    x |= {"doc": column("doc", np.int64)[of], "size": column("size", np.int32)[of]}
    return x | {"kind": np.where(indexed(x["size"].astype(np.int64), x["at"], t), INDEX | PROBE, PROBE).astype(np.int8)}


def _meet(t: float, bucket: int, exact: bool):
    """Within a partition of keys: pairs of different documents of which one probes a key that the other is indexed under, each once.

    In exact mode it is enough that the smaller one is indexed (either, at equal sizes).

    A bucket of more than bucket**2 meetings leaves in blocks (key, -1, members, nothing, number, count).
    """

    def run(batches):
        x = _unpacked(batches, t) if exact else _columns(batches)
        if not len(x["key"]):
            return
        by = [c for c in ("key", "size", "doc", "at", "s0", "s1") if c in x]
        order = np.lexsort([x[c] for c in reversed(by)])
        x = {c: v[order] for c, v in x.items()}
        del order
        head = np.flatnonzero(np.append(True, np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in by])))  # an id may have several sets
        who = np.empty(len(head), LISTED if exact else MEMBER)
        who["flags"] = np.bitwise_or.reduceat(x["kind"], head)
        for c in by[1:]:
            who[c] = x[c][head].astype(who.dtype[c], copy=False)
        key = x["key"][head]
        del x, head
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        probes = np.add.reduceat(((who["flags"] & PROBE) > 0).astype(np.int64), start)
        met = (probes > 0) & (count > 1)  # others wait in vain
        keep = np.repeat(met, count)
        key, who, start, count, probes = key[keep], who[keep], None, count[met], probes[met]
        if not len(key):
            return
        start = np.cumsum(count) - count
        large = probes * count > bucket * bucket
        for k in np.flatnonzero(large):
            m = -(-int(count[k]) // bucket)
            for i in range(m):
                blob = who[start[k] + i * bucket : start[k] + min((i + 1) * bucket, int(count[k]))].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(key[start[k] : start[k] + 1]), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), pa.array([b""], pa.binary()), pa.array([i], pa.int32()), pa.array([m], pa.int32())], _MET)
        members, found = _Members(who), _Found()
        last = _near_sizes(who["size"], np.repeat(np.arange(len(count)), count), t)
        x = np.flatnonzero((members.index | (not exact)) & ~np.repeat(large, count))
        for x, y in _spans(x + 1, last[x], x):
            found.add(*members.fit(x, y, t, exact))
        yield from found.batches()

    return run


def _meet_blocks(t: float, exact: bool):
    """Pairs of one part (two blocks, or one with itself) of a large bucket, whose members are in the order of their sizes."""

    def run(table):
        numbers = np.asarray(table["blk"])
        blocks = [np.frombuffer(table["bs"][int(k)].as_py(), LISTED if exact else MEMBER) for k in np.argsort(numbers)]
        members, found, n = _Members(np.concatenate(blocks)), _Found(), len(blocks[0])
        last = _near_sizes(members.size, np.zeros(len(members.doc), np.int64), t)
        x = np.flatnonzero((members.index | (not exact)) & (np.arange(len(members.doc)) < n))
        for x, y in _spans(np.maximum(x + 1, n) if len(blocks) > 1 else x + 1, last[x], x):
            found.add(*members.fit(x, y, t, exact))
        got = list(found.batches())
        return pa.Table.from_batches(got) if got else _MET_TYPE.empty_table()

    return run


def pack(ids: np.ndarray) -> bytes:
    """Ascending ids as differences, deflated where that pays."""
    raw = np.diff(ids, prepend=0).astype("<i8").tobytes()
    return zlib.compress(raw, 1) if len(raw) > 64 else raw


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob if 8 * n <= 64 else zlib.decompress(blob), "<i8"))


#: Sets of a side of a block of the verification, ids up to which a table is broadcast.
SIDE, BROADCAST_IDS = 1024, 1 << 20


def linked(docs: DataFrame, t: float = THRESHOLD, n: int = N, recall: float = RECALL, ratio: float = RATIO, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, class_id, links) of every document, as described above."""
    exact = recall >= 1
    members = saved(_sets(docs, n), "sets")
    own = ["h", "h2", "size"]
    reps = saved(members.where("size > 0").groupBy(*own).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    several = reps.where("n > 1")
    copies = saved(join_groups(members, several, own).where("doc != rep").select("doc"), "copies")
    send = lambda d, count: F.broadcast(d) if count <= BROADCAST_IDS else d
    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.lower("text").alias("text")).where("doc is not null")
    one = src.join(send(copies, copies.count()), "doc", "left_anti")
    if exact:
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (reps.agg(F.sum("size")).first()[0] or 0) // PART_GRAMS + 1)
        rows = _listed(one, t, n, _ranks(one, n), parts).repartitionById(parts, "part")
    else:
        bands = Bands(t, max(ratio, 1 / t), recall)
        rows = _rows(one, bands, n, _common(one, bands, n)).repartition("key")
    met = saved(rows.mapInArrow(lean(_meet(t, bucket, exact)), _MET_SCHEMA), "met")
    lists, large = met.where("n >= 0"), met.where("n < 0")
    if not large.isEmpty():
        i = F.col("blk")
        part = F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda j: F.least(i, j).cast("long") * F.col("of") + F.greatest(i, j)))
        lists = lists.union(large.withColumn("part", part).groupBy("a", "part").applyInArrow(_meet_blocks(t, exact), _MET_SCHEMA))

    def met_enough(batches):
        found = _Found()
        for b in batches:
            if b.num_rows:
                lists = [unpack(x, k) for x, k in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
                found.add(np.repeat(np.asarray(b.column(0)), [len(x) for x in lists]), np.concatenate(lists), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8))
        p = found.pairs()
        p = p[p["w"] >= FULL]
        for k in range(0, len(p), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[c][k : k + (1 << 16)])) for c in ("a", "b")], ["a", "b"])

    pairs = saved(lists.repartition("a").mapInArrow(lean(met_enough), "a long, b long"), "pairs")
    drop(met)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    involved = both.groupBy("a").agg(F.min("b").alias("low")).join(reps.select(F.col("rep").alias("a"), "n"), "a").select(F.col("a").alias("doc"), "low", "n")
    involved = saved(involved, "involved")
    count = involved.count()

    def sets(batches):
        for b in batches:
            for i, j, buf, off in texts(b.column(1)):
                g, doc = token_sets(buf, off, n)
                _, size = set_keys(g, doc, j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(g.view(np.int64)))], ["doc", "grams"])

    # Sets meet in blocks: pair (a, b) in block (side of a, side of b).  Documents under one least partner share a side
    # (several, if they are very many), so a set of a large family of copies travels to one block or few.
    g = max(1, -(-count // SIDE))
    led = involved.select("doc", F.least("doc", "low").alias("leader"))
    parts = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts"))
    sides = led.join(send(parts, count), "leader").select("doc", F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64("doc"), "parts")), F.lit(g)).alias("side"))
    left_side, right_side = (sides.select(F.col("doc").alias(c), F.col("side").alias(f"side_{c}")) for c in ("a", "b"))
    blocks = pairs.join(send(left_side, count), "a").join(send(right_side, count), "b").select((F.col("side_a") * g + F.col("side_b")).alias("block"), "a", "b")
    needed = saved(blocks.select(F.col("block").alias("of"), F.explode(F.array("a", "b")).alias("doc")).distinct().join(send(involved.select("doc", "n"), count), "doc"), "needed")
    wanted = one.join(send(involved.select("doc"), count), "doc", "left_semi")
    grams = wanted.mapInArrow(lean(sets), "doc long, grams array<long>").join(send(needed, needed.count()), "doc")

    def verify(left, right):
        a, b = np.asarray(left["a"]), np.asarray(left["b"])
        have: dict[int, np.ndarray] = {}
        times = dict(zip(right["doc"].to_pylist(), right["n"].to_pylist()))
        for d, s in zip(right["doc"].to_pylist(), right["grams"]):
            s = np.asarray(s.values)
            have[d] = min(have[d], s, key=lambda v: int(set_keys(v.view(np.uint64), np.zeros(len(v), np.int64), 1)[0].view(np.int64)[0])) if d in have else s
        ok = np.array([x in have and y in have and jaccard(have[x], have[y]) >= t - 1e-12 for x, y in zip(a.tolist(), b.tolist())], bool)
        return _summed(a[ok], b[ok], times)

    left = blocks.select("block", "a", "b").groupBy("block")
    checked = saved(left.cogroup(grams.select("of", "doc", "n", "grams").groupBy("of")).applyInArrow(verify, "doc long, links long, root long"), "checked")
    drop(pairs, involved, needed)
    found = checked.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("found"))
    classes = components(checked.select("doc", "root").where("doc != root").distinct())
    known = reps.join(found, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    known = saved(known.select(*own, "n", F.coalesce("root", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("links")), "known")
    drop(reps, copies, checked, classes)
    out = join_groups(members.where("size > 0"), known, own).select(F.col("doc").alias("doc_id"), "class_id", "links")
    return out.unionByName(members.where("size = 0").select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("links")))


def _summed(a: np.ndarray, b: np.ndarray, times: dict[int, int]) -> pa.Table:
    """(doc, links, root) of the documents of linked pairs: links weigh the copies of the other, root is the least of those linked here."""
    who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = np.array([times[d] for d in who.tolist()], np.int64)
    x, y = at[: len(a)], at[len(a) :]
    links = np.bincount(x, n[y], len(who)) + np.bincount(y, n[x], len(who))
    return pa.table({"doc": pa.array(who), "links": pa.array(links.astype(np.int64)), "root": pa.array(who[forest(len(who), x, y)])})


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets given as ascending unsigned arrays seen as signed."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(read(spark, f"{sf_dir}/documents.parquet"))
