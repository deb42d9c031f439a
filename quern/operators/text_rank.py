"""BM25 ranking and composite scores.

Without an index, each text attribute of a query is tokenised once a pass, for
all clauses that rank by it, into a struct of fixed width: the length and the
counts of the query's terms.  One pass aggregates the corpus statistics (number
of documents, mean length, document frequencies), the other scores; nothing is
exploded or shuffled but the partial sums.

With an index (`Postings`) a query reads only the postings of its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import Compiler
from quern.functions.stemming import STEMMERS
from quern.functions.textproc import Fts, terms_of, tokenize
from quern.sources.tables import spread


#: Tokens counted at once when postings are made: what a Python worker needs does not grow with its documents.
PART_TOKENS = 1 << 18


class RankError(ValueError):
    """The ranking is malformed."""


def parse_query(query: str | dict, fts: Fts) -> tuple[Counter, str | None]:
    """(terms with their repeats, the prefix or None) of a text or {"query": text, "last_as_prefix": true}."""
    text = query.get("query", "") if isinstance(query, dict) else query
    if not isinstance(text, str):
        raise RankError("a BM25 query is a text")
    terms = terms_of(text, fts)
    if isinstance(query, dict) and query.get("last_as_prefix") and terms:
        return Counter(terms[:-1]), terms[-1]
    return Counter(terms), None


def _starts(tokens: Column, prefix: str) -> Column:
    return F.exists(tokens, lambda x: x.startswith(prefix)).cast("int")


@dataclass
class Counts:
    """Length and term counts of one attribute under one setting: the struct column `name` with dl, t0, t1, ... and p0, ... for prefixes."""

    attribute: str
    fts: Fts
    name: str
    terms: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)

    def add(self, times: Counter, prefix: str | None) -> None:
        for t in times:
            self.terms.setdefault(t, len(self.terms))
        if prefix is not None:
            self.prefixes.setdefault(prefix, len(self.prefixes))

    def column(self) -> Column:
        tokens = tokenize(F.col(f"`{self.attribute}`"), self.fts)
        step = STEMMERS.get(self.fts.language) if self.fts.stemming else None
        names = ["dl", *(f"t{i}" for i in self.terms.values()), *(f"p{i}" for i in self.prefixes.values())]
        if step is None:  # bound as a lambda's variable, the tokens are made once
            def measure(t):
                size = F.size(t)
                found = [size - F.size(F.array_remove(t, x)) for x in self.terms]
                return F.struct(*[c.alias(n) for c, n in zip([size, *found, *(_starts(t, p) for p in self.prefixes)], names)])

            return F.transform(F.array(tokens), lambda t: F.when(t.isNotNull(), measure(t)))[0]
        terms, prefixes = list(self.terms), list(self.prefixes)
        # a stemmer drops leading apostrophes and changes ends, so only tokens that begin as a term does can have its stem
        heads = sorted({x[:1].lower()[:1] for x in (*terms, *prefixes)} | {"'", "’"})
        begins = lambda x: F.substring(F.lower(F.substring(x, 1, 1)), 1, 1).isin(*heads)
        kept = F.transform(F.array(tokens), lambda t: F.when(t.isNotNull(), F.struct(F.size(t).alias("dl"), F.filter(t, begins).alias("kept"))))[0]

        def count(docs):
            lists = docs.field("kept")
            doc = np.repeat(np.arange(len(docs)), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten().dictionary_encode()  # distinct tokens of the batch are stemmed once
            stems, code = [step(x) for x in flat.dictionary.to_pylist()], np.asarray(flat.indices)
            found = lambda hits: np.bincount(doc[np.array(hits, bool)[code]], minlength=len(docs))
            out = [np.asarray(docs.field("dl").fill_null(0)), *(found([s == x for s in stems]) for x in terms), *(np.minimum(found([s.startswith(x) for s in stems]), 1) for x in prefixes)]
            values = pa.array(np.stack(out, 1).astype(np.int32).ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32) * len(out)), values, mask=docs.is_null())

        count.__annotations__ = {"docs": pa.Array, "return": pa.Array}
        got = F.arrow_udf(count, "array<int>")(kept)
        return F.transform(F.array(got), lambda a: F.when(a.isNotNull(), F.struct(*[a[i].alias(n) for i, n in enumerate(names)])))[0]


def _score(c: Counts, times: Counter, prefix: str | None, stats: str) -> Column:
    """score = sum over query tokens (repeats count) of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)) with idf = ln((N - n + 1/2) / (n + 1/2) + 1); a prefix needs every other token and adds exactly 1."""
    row, all_ = (lambda f: F.col(f"`{c.name}`.{f}").cast("double")), (lambda f: F.col(f"`{stats}`.{f}"))
    k1, b, out = c.fts.k1, c.fts.b, F.lit(0.0)
    share = row("dl") / F.nullif(all_("dl") / all_("n"), F.lit(0.0))
    for x, m in times.items():
        tf, n = row(f"t{c.terms[x]}"), all_(f"t{c.terms[x]}")
        idf = F.log((all_("n") - n + 0.5) / (n + 0.5) + 1)
        out = out + F.lit(float(m)) * F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))).otherwise(0.0)
    if prefix is not None:
        needed = reduce(lambda a, t: a & (row(f"t{c.terms[t]}") > 0), times, row(f"p{c.prefixes[prefix]}") > 0)
        out = F.when(needed, out + 1.0).otherwise(0.0)
    return F.coalesce(out, F.lit(0.0))


def ranked(df: DataFrame, rank: list, fts_of: Callable[[str], Fts], compiler: Compiler, out: str = "$dist", stats: DataFrame | None = None) -> DataFrame:
    """df with the score of a ranking in `out`; statistics over `stats`, all of df unless given.

    Leaves are [field, "BM25", q] and, inside composites, filters, which score 1
    or 0; ["Sum", [c, ...]] adds, ["Max", [c, ...]] takes the greatest (0 if
    empty), ["Product", weight, c] (either order) scales.
    """
    counts: dict[tuple[str, Fts], Counts] = {}
    made: list[tuple[Counts, Counter, str | None]] = []

    def walk(node: object, top: bool) -> Callable[[], Column]:
        if not isinstance(node, (list, tuple)) or not node:
            raise RankError(f"no ranking: {node!r}")
        if node[0] in ("Sum", "Max"):
            if len(node) != 2 or not isinstance(node[1], (list, tuple)):
                raise RankError(f"{node[0]} takes a list")
            parts = [walk(c, False) for c in node[1]]
            if not parts:
                return lambda: F.lit(0.0)
            if node[0] == "Sum":
                return lambda: reduce(lambda a, b: a + b, [p() for p in parts])
            return parts[0] if len(parts) == 1 else lambda: F.greatest(*[p() for p in parts])
        if node[0] == "Product":
            if len(node) != 3:
                raise RankError("Product takes a weight and a clause")
            weight, clause = (node[1], node[2]) if isinstance(node[1], (int, float)) else (node[2], node[1])
            if isinstance(weight, bool) or not isinstance(weight, (int, float)):
                raise RankError("Product needs a number")
            inner = walk(clause, False)
            return lambda: F.lit(float(weight)) * inner()
        if len(node) == 3 and node[1] == "BM25":
            fts = fts_of(node[0])
            times, prefix = parse_query(node[2], fts)
            if not times and prefix is None:
                return lambda: F.lit(0.0)
            c = counts.setdefault((node[0], fts), Counts(node[0], fts, f"$counts{len(counts)}"))
            c.add(times, prefix)
            made.append((c, times, prefix))
            return lambda: _score(c, times, prefix, f"$stats{c.name}")
        if top:
            raise RankError("a filter ranks only inside a composite")
        test = compiler.compile(node)
        return lambda: F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)

    score = walk(rank, True)
    if not counts:
        return df.withColumn(out, score().cast(T.DoubleType()))
    base = spread((df if stats is None else stats).select(*[F.col(f"`{a}`") for a in dict.fromkeys(a for a, _ in counts)]))
    sums = []
    for c in counts.values():
        x = F.col(f"`{c.name}`")
        parts = [F.coalesce(F.sum(x["dl"]), F.lit(0)).cast("double").alias("dl"), F.count(x).cast("double").alias("n")]
        parts += [F.coalesce(F.sum((x[f"t{i}"] > 0).cast("int")), F.lit(0)).cast("double").alias(f"t{i}") for i in c.terms.values()]
        sums.append(F.struct(*parts).alias(f"$stats{c.name}"))
    one = base.select(*[c.column().alias(c.name) for c in counts.values()]).agg(*sums)
    df = spread(df).withColumns({c.name: c.column() for c in counts.values()}).crossJoin(F.broadcast(one))  # one row
    return df.withColumn(out, score().cast(T.DoubleType())).drop(*[n for c in counts.values() for n in (c.name, f"$stats{c.name}")])


def is_composite(rank: object) -> bool:
    return isinstance(rank, (list, tuple)) and bool(rank) and rank[0] in ("Sum", "Max", "Product")


def parts(b: pa.RecordBatch, tokens: int = PART_TOKENS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column, of token lists, has about so many tokens each, and a document at least."""
    ends, at = np.cumsum(np.asarray(b.column(1).value_lengths()).astype(np.int64)), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
        yield b.slice(at, to - at)
        at = to


def postings(df: DataFrame, key: str, attribute: str, fts: Fts) -> DataFrame:
    """(term, key, tf, dl) of all documents with a text; one of no tokens has one row of a null term."""
    step = STEMMERS.get(fts.language) if fts.stemming else None
    src = df.select(F.col(f"`{key}`").alias("key"), tokenize(F.col(f"`{attribute}`"), fts).alias("tokens")).where("tokens is not null")

    def run(batches):
        for b in (part for whole in batches for part in parts(whole)):
            lists = b.column(1)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            names = [step(x) for x in flat.dictionary.to_pylist()] if step else flat.dictionary.to_pylist()
            kinds = sorted(set(names))
            number = {x: i for i, x in enumerate(kinds)}
            code = np.array([number[x] for x in names], np.int64)[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(b.num_rows), size)
            pair, tf = np.unique(doc * max(len(kinds), 1) + code, return_counts=True)
            of, term = pair // max(len(kinds), 1), pair % max(len(kinds), 1)
            none = np.flatnonzero(size == 0)
            words = pa.array(kinds, pa.string()).take(pa.array(term)) if kinds else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words, pa.nulls(len(none), pa.string())]), b.column(0).take(pa.array(np.concatenate([of, none]))), pa.array(np.concatenate([tf, np.zeros(len(none), np.int64)]).astype(np.int32)), pa.array(size[np.concatenate([of, none])].astype(np.int32))], ["term", "key", "tf", "dl"]
            )

    return src.mapInArrow(run, f"term string, key {src.schema['key'].dataType.simpleString()}, tf int, dl int")


@dataclass
class Postings:
    """Inverted index of one attribute on disk, sorted by term; `gone` keys are void, `fresh` documents count instead."""

    path: str
    key: str
    attribute: str
    fts: Fts
    docs: int
    length: int
    gone: DataFrame | None = None
    fresh: DataFrame | None = None

    @staticmethod
    def write(df: DataFrame, path: str, key: str, attribute: str, fts: Fts) -> tuple[int, int]:
        """Write the postings of df below path, in ranges of (term, key), and the lengths; (documents with a text, sum of their lengths)."""
        rows = postings(df, key, attribute, fts)
        rows.where("term is not null").repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings")
        spark = df.sparkSession
        size = F.size("tokens")
        lengths = df.select(F.col(f"`{key}`").alias("key"), tokenize(F.col(f"`{attribute}`"), fts).alias("tokens")).where("tokens is not null").select("key", size.alias("dl"))
        lengths.write.parquet(f"{path}/lengths")
        got = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return got.n, got.dl

    def score(self, df: DataFrame, query: str, out: str = "$dist") -> DataFrame:
        """(key, out) of the documents with a term of the query."""
        times, _ = parse_query(query, self.fts)
        spark = df.sparkSession
        found = spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin(*times)) if times else None
        if found is None:
            return df.sparkSession.createDataFrame([], T.StructType([df.schema[self.key], T.StructField(out, T.DoubleType())]))
        n, length = F.lit(float(self.docs)), F.lit(float(self.length))
        joined = None
        if self.gone is not None:
            found = found.join(self.gone, found["key"] == self.gone[self.key], "left_anti")
            void = spark.read.parquet(f"{self.path}/lengths").join(self.gone, F.col("key") == self.gone[self.key], "left_semi").select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"))
            new = postings(self.fresh, self.key, self.attribute, self.fts)
            found = found.unionByName(new.where(F.col("term").isin(*times)))
            more = new.dropDuplicates(["key"]).select(F.lit(1).alias("n"), "dl")
            joined = void.unionByName(more).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("more_n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("more_dl"))
            n, length = n + F.col("more_n"), length + F.col("more_dl")
        per = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # a row a query term
        repeats = F.create_map(*[F.lit(v) for t, m in times.items() for v in (t, float(m))])
        rows = found.join(F.broadcast(per), "term")
        if joined is not None:
            rows = rows.crossJoin(F.broadcast(joined))  # one row
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = repeats[F.col("term")] * idf * F.col("tf") * (self.fts.k1 + 1) / (F.col("tf") + self.fts.k1 * (1 - self.fts.b + self.fts.b * F.col("dl") / F.nullif(length / n, F.lit(0.0))))
        return rows.groupBy(F.col("key").alias(self.key)).agg(F.sum(part).alias(out))
