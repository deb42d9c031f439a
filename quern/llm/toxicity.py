"""Toxicity by lexicon induction on a word graph.

1. Labelled documents (a bounded sample, TRAIN_ROWS) give each word the smoothed
   log-odds of standing in toxic against clean documents and a z by which they
   exceed LEAST_ODDS (so that a slight lean of a frequent word counts for nothing).
   Copies must not speak many times: documents of one least word-trigram hash
   share one vote.  The words of highest
   z seed the toxic side; frequent words of no toxic lean seed the clean side.
   Graph terms are the seeds, all words with z of at least TERM_Z (the GRAPH_TERMS
   strongest), and, labelled or not, all words of the corpus that keep company
   with toxic seeds: of the documents that hold the word, so many have it within
   WINDOW words of a toxic seed that odds LEAST_ODDS above those of words at large
   would give as many to less than one word of the vocabulary.
2. Over all documents, graph terms within WINDOW words of one another are
   counted, and positive pointwise mutual information, less SHIFT (two words of
   one language inform of each other a little in any mixed corpus), weighs the
   graph's edges.
3. Two random walks with restart, one from each set of seeds, give every term a
   share of visits; its polarity is the difference over the sum.
4. A document's score is the sum of the positive polarities of its distinct
   lexicon terms, seeds weighed by how sure their label evidence is; the
   threshold separating toxic from clean is fitted on the labelled sample.

Words are lower-cased runs of letters and digits (bytes >= 0x80 included).

Defined cases: null and empty texts score 0 and are not toxic; labels repeated
for a document count as their maximum, null labels not at all; without both
classes among the labels every score is 0; ties in z go to the word of least
hash; only doc_id, text, toxic are read; every row is scored, repeats too; long texts
are counted and scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import HashIndex, mix, ngrams, saved, texts, words

#: Labelled documents read at most; toxic seeds, graph terms and clean seeds at most; least z of a term and a seed; log-odds that count as none.
TRAIN_ROWS, SEEDS, GRAPH_TERMS, TERM_Z, SEED_Z, LEAST_ODDS = 20000, 400, 4000, 2.0, 2.5, 1.5
CLEAN_SEEDS, CLEAN_SHARE = 300, 0.08
#: Window in words, restart share and steps of the walks, and by how much information must exceed chance to make an edge.
WINDOW, RESTART, STEPS, SHIFT = 30, 0.15, 60, 2.0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, y_, vote_) of the labelled documents with the least id hashes, `rows` of them at most."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y_"))
    ids = {r.doc_id: int(r.y_ > 0) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}

    def sketch(batches):
        for b in batches:
            least = np.zeros(b.num_rows, np.uint64)
            for i, j, buf, off in texts(b.column(1)):
                g, doc = ngrams(*words(buf, off), 3)
                low = np.full(j - i, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(low, doc, mix(g))
                least[i:j] = low
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least.view(np.int64))], ["doc_id", "least"])

    some = spark.createDataFrame(list(ids.items()), f"doc_id {kind}, y_ int")
    text = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(some), "doc_id")
    keys = text.select("doc_id", "text").mapInArrow(sketch, f"doc_id {kind}, least long").toPandas()  # ids of a bounded sample
    votes = 1 / keys.groupby("least")["least"].transform("size") if len(keys) else keys["least"]
    share = dict(zip(keys["doc_id"].tolist(), votes.tolist()))
    voted = spark.createDataFrame([(d, y, float(share.get(d, 1.0))) for d, y in ids.items()], f"doc_id {kind}, y_ int, vote_ double")
    return docs.select("doc_id", "text").join(F.broadcast(voted), "doc_id").select(F.lower("text").alias("text"), "y_", "vote_")


def _distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def word_odds(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(word hashes, toxic and clean document votes, all toxic and clean votes) of words with 2 votes or more."""

    def count(batches):
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            y, vote = np.asarray(b.column(1)), np.asarray(b.column(2))
            sums.append((np.zeros(1, np.uint64), np.array([vote[y == 1].sum()]), np.array([vote[y == 0].sum()])))
            for i, j, buf, off in texts(b.column(0)):
                h, doc = _distinct(*words(buf, off))
                key, of = np.unique(h, return_inverse=True)
                toxic, v = y[i:j][doc], vote[i:j][doc]
                sums.append((key, np.bincount(of, toxic * v, len(key)), np.bincount(of, (1 - toxic) * v, len(key))))
        if sums:
            h, t, c = (np.concatenate(x) for x in zip(*sums))
            key, of = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(of, t, len(key))), pa.array(np.bincount(of, c, len(key)))], ["word", "toxic", "clean"])

    got = sample.mapInArrow(count, "word long, toxic double, clean double").groupBy("word").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean")).where("toxic + clean >= 2 or word = 0")
    table = got.toPandas().sort_values("word")  # vocabulary of a bounded sample
    word, toxic, clean = table["word"].to_numpy(np.int64).view(np.uint64), table["toxic"].to_numpy(float), table["clean"].to_numpy(float)
    total = word == 0
    n = (float(toxic[total].sum()), float(clean[total].sum()))
    return word[~total], toxic[~total], clean[~total], *n


def choose(word, toxic, clean, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(graph terms, whether a toxic seed, whether a clean seed, confidence)."""
    none = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0)
    if not n_toxic or not n_clean or not len(word):
        return none
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n_toxic + 1 - a + 0.5)) - np.log(b / (n_clean + 1 - b + 0.5))
    z = (odds - LEAST_ODDS) / np.sqrt(1 / a + 1 / b)
    strong = np.lexsort((word, -z))
    strong = strong[z[strong] >= TERM_Z][:GRAPH_TERMS]
    if not len(strong):
        return none
    seeds = strong[z[strong] >= min(SEED_Z, z[strong[0]])][:SEEDS]
    share = (toxic + clean) / (n_toxic + n_clean)
    common = np.flatnonzero((odds <= 0.5) & (share <= CLEAN_SHARE))
    common = common[np.lexsort((word[common], -clean[common]))][:CLEAN_SEEDS]
    at = np.concatenate([strong, common])
    return word[at], np.isin(at, seeds), np.arange(len(at)) >= len(strong), np.clip(z[at] / max(float(z[strong[0]]), 1e-9), 0, 1)


def cooccurrence(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """(term, term, times) of graph terms within WINDOW words of one another, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(HashIndex(terms))
    n = len(terms)

    def count(batches):
        index = shared.value
        kept, held = [np.zeros(0, np.int64)], 0
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for _, _, buf, off in texts(b.column(0)):
                h, bounds = words(buf, off)
                at = index.get(h)
                pos = np.flatnonzero(at >= 0)
                term = at[pos].astype(np.int64)
                last = np.repeat(bounds[1:], np.diff(bounds))[pos]  # end of the document that each stands in
                for k in range(1, len(pos)):
                    ok = (pos[k:] - pos[:-k] <= WINDOW) & (pos[k:] < last[:-k])
                    if not ok.any():
                        break
                    x, y = term[:-k][ok], term[k:][ok]
                    kept.append(np.minimum(x, y) * n + np.maximum(x, y))
                    held += len(x)
                if held > 1 << 21:
                    sums.append(np.unique(np.concatenate(kept), return_counts=True))
                    kept, held = [np.zeros(0, np.int64)], 0
        sums.append(np.unique(np.concatenate(kept), return_counts=True))
        code, times = (np.concatenate(x) for x in zip(*sums))
        code, of = np.unique(code, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(of, times, len(code)).astype(np.int64))], ["code", "times"])

    got = docs.select(F.lower("text").alias("text")).mapInArrow(count, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).toPandas()
    code = got["code"].to_numpy(np.int64)
    return np.column_stack([code // n, code % n, got["times"].to_numpy(np.int64)]) if len(code) else np.zeros((0, 3), np.int64)


def company(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    """(word, docs, near) of all words of the corpus: documents that hold it, and those that have it within WINDOW words of a seed."""
    shared = docs.sparkSession.sparkContext.broadcast(HashIndex(seeds))

    def total(parts):
        h, n, near = (np.concatenate(x) for x in zip(*parts))
        key, of = np.unique(h, return_inverse=True)
        return key, np.bincount(of, n, len(key)).astype(np.int64), np.bincount(of, near, len(key)).astype(np.int64)

    def out(h, n, near):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(near)], ["word", "docs", "near"])

    def count(batches):
        held, size = [], 0
        for b in batches:
            for _, _, buf, off in texts(b.column(0)):
                h, bounds = words(buf, off)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                pos = np.flatnonzero(shared.value.get(h) >= 0)
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.maximum(pos - WINDOW, bounds[:-1][doc[pos]]), 1)
                np.add.at(edge, np.minimum(pos + WINDOW + 1, bounds[1:][doc[pos]]), -1)
                near = np.cumsum(edge)[:-1] > 0
                all_h, _ = _distinct(h, bounds)
                some = np.flatnonzero(near)
                near_h, _ = _distinct(h[some], np.searchsorted(some, bounds))
                held += [(all_h, np.ones(len(all_h)), np.zeros(len(all_h))), (near_h, np.zeros(len(near_h)), np.ones(len(near_h)))]
                size += len(all_h) + len(near_h)
                if size > 1 << 21:
                    held = [total(held)]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*total(held))

    src = docs.select(F.lower("text").alias("text")).where("text is not null")
    return src.mapInArrow(count, "word long, docs long, near long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("near").alias("near"))


def companions(docs: DataFrame, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the corpus that stand by toxic seeds in more of their documents than chance gives to one word of the vocabulary; by how much their log-odds exceed chance."""
    table = saved(company(docs, seeds), "company")
    types, n, near = table.agg(F.count(F.lit(1)), F.sum("docs"), F.sum("near")).first()
    if not near or near == n:
        return np.zeros(0, np.uint64), np.zeros(0)
    p = 1 / (1 + (n - near) / near * np.exp(-LEAST_ODDS))
    k, m = F.col("near").cast("double"), F.col("docs") - F.col("near")
    # Chernoff: k of n by chance p has a probability of at most exp(-excess)
    excess = k * F.log(k / (F.col("docs") * p)) + F.when(m > 0, m * F.log(m / (F.col("docs") * (1 - p)))).otherwise(0)
    got = table.where(k > F.col("docs") * p).where(excess >= float(np.log(max(types, 2)))).toPandas().sort_values("word")
    word, k, m = got["word"].to_numpy(np.int64).view(np.uint64), got["near"].to_numpy(float), (got["docs"] - got["near"]).to_numpy(float)
    return word, np.maximum(np.log((k + 0.5) / (m + 0.5)) - np.log(p / (1 - p)), 0)


def polarity(edges: np.ndarray, toxic: np.ndarray, clean: np.ndarray, company: np.ndarray | None = None) -> np.ndarray:
    """Polarity of each term in [-1, 1] by random walks over the PPMI graph; a term's edges to toxic seeds weigh its `company` together at least."""
    n = len(toxic)
    edges = edges[edges[:, 0] != edges[:, 1]]
    x, y = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    c = np.concatenate([edges[:, 2]] * 2).astype(float)
    deg = np.bincount(x, c, n)
    w = np.maximum(np.log(c * max(c.sum(), 1) / np.maximum(deg[x] * deg[y], 1e-12)) - SHIFT, 0) if len(c) else c
    if company is not None and len(c):
        for a, b in ((x, y), (y, x)):
            to = c * (toxic[b] & ~toxic[a])
            w = np.maximum(w, company[a] * to / np.maximum(np.bincount(a, to, n)[a], 1))
    out = np.bincount(x, w, n)
    step = w / np.maximum(out[x], 1e-12)
    visits = []
    for seeds in (toxic, clean):
        start = seeds / max(seeds.sum(), 1)
        p = start.copy()
        for _ in range(STEPS):
            moved = np.bincount(y, p[x] * step, n)
            p = (1 - RESTART) * (moved + start * max(0.0, 1 - moved.sum())) + RESTART * start
        visits.append(p)
    a, b = visits
    return np.divide(a - b, a + b, out=np.zeros(n), where=a + b > 0)


class Lexicon:
    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        keep = weights > 0
        self.index, self.weights, self.threshold = HashIndex(terms[keep]), np.rint(weights[keep] * 4096).astype(np.int64), np.inf

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col), np.int64)
        if not len(self.weights):
            return out.astype(float)
        for i, j, buf, off in texts(col):
            h, bounds = words(buf, off)
            at = self.index.get(h)
            pos = np.flatnonzero(at >= 0)
            doc = np.searchsorted(bounds, pos, "right") - 1
            pair = np.unique(doc * len(self.weights) + at[pos])
            out[i:j] = np.bincount(pair // len(self.weights), self.weights[pair % len(self.weights)], j - i)
        return out / 4096


def induce(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    sample = _sample(docs, labels, rows)
    terms, toxic, clean, sure = choose(*word_odds(sample))
    if not len(terms):
        return Lexicon(terms, sure)
    more, excess = companions(docs, terms[toxic])
    new = ~np.isin(more, terms)
    more, excess, none = more[new], excess[new], np.zeros(int(new.sum()), bool)
    company_of = np.append(np.zeros(len(terms)), excess)
    terms, toxic, clean = np.append(terms, more), np.append(toxic, none), np.append(clean, none)
    sure = np.where(toxic | clean, np.append(sure, np.ones(len(more))), 1.0)
    lexicon = Lexicon(terms, np.maximum(polarity(cooccurrence(docs, terms), toxic, clean, company_of), 0) * sure)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(b.column(0))), b.column(1)], ["score", "y_"])

    got = sample.mapInArrow(run, "score double, y_ int").toPandas()  # bounded by `rows`
    s, y = got["score"].to_numpy(), got["y_"].to_numpy()
    cuts = np.unique(s)
    t, f = (np.searchsorted(np.sort(s[y == k]), cuts, "left") for k in (1, 0))
    error = t + 2 * ((y == 0).sum() - f)  # a clean document flagged weighs twice a toxic one missed
    best = int(error.argmin())
    lexicon.threshold = float(cuts[best] + (cuts[best - 1] if best else cuts[best])) / 2 if cuts[best] > 0 else np.inf
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= shared.value.threshold)], ["doc_id", "toxicity", "toxic"])

    src = docs.select("doc_id", F.lower("text").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, toxicity double, toxic boolean")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, f"{sf_dir}/documents.parquet")
    return toxicity(docs, induce(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
