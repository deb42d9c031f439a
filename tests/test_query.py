import pytest
from pyspark.sql import functions as F

from quern.functions.filters import FilterError
from quern.functions.stemming import english, norwegian, swedish
from quern.functions.textproc import Fts, FtsError, terms_of, tokenize
from quern.functions.vectors import VectorError, decode_vector, encode_vector, floats_to_half, half_to_floats
from quern.operators import ann
from quern.operators.aggregate import AggregateError
from quern.operators.text_rank import RankError
from quern.plans.query import Collection, QueryError

PRODUCTS = [
    (1, "Widget A", "widgets", 19.99, 100, True), (2, "Widget B", "widgets", 24.99, 50, True), (3, "Gadget X", "gadgets", 99.99, 25, True), (4, "Gadget Y", "gadgets", 149.99, 10, False),
    (5, "Tool Alpha", "tools", 49.99, 75, True), (6, "Tool Beta", "tools", 59.99, 30, True), (7, "Part 100", "parts", 5.99, 500, True), (8, "Part 200", "parts", 8.99, 300, True),
    (9, "Part 300", "parts", 12.99, 200, False), (10, "Special Item", "special", 999.99, 5, True),
]


def one(df):
    return df.collect()[0].asDict()


def test_products(spark):
    c = Collection(spark.createDataFrame(PRODUCTS, "id long, name string, category string, price double, stock int, active boolean"))
    spec = {"n": ["Count"], "s": ["Sum", "stock"]}
    assert one(c.query({"aggregate_by": spec})) == {"n": 10, "s": 1295.0}
    assert one(c.query({"aggregate_by": spec, "filters": ["category", "Eq", "widgets"]})) == {"n": 2, "s": 150.0}
    groups = c.query({"aggregate_by": {"n": ["Count"]}, "group_by": ["category"]}).collect()
    assert [tuple(r) for r in groups] == [("gadgets", 2), ("parts", 3), ("special", 1), ("tools", 2), ("widgets", 2)]
    assert len(c.query({"aggregate_by": {"n": ["Count"]}, "group_by": ["category"], "limit": 2}).collect()) == 2
    assert one(c.query({"aggregate_by": {"s": ["Sum", "stock"]}, "filters": ["id", "Gt", 99]})) == {"s": 0.0}
    assert c.query({"rank_by": ["price", "desc"], "limit": 1, "include_attributes": ["price"]}).columns == ["id", "price"]
    assert "price" not in c.query({"rank_by": ["id", "asc"], "exclude_attributes": ["price", "id"]}).columns


def test_order_nulls_and_per(spark):
    rows = [(1, "A", 100), (2, "A", 90), (3, "A", 80), (4, "B", 95), (5, "B", 85), (6, "C", 92)]
    c = Collection(spark.createDataFrame(rows, "id long, category string, score int"))
    out = c.query({"rank_by": ["score", "desc"], "limit": 2, "per": ["category"]})
    assert [r.id for r in out.collect()] == [1, 4, 6, 2, 5]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    top = c.query({"rank_by": ["score", "desc"], "limit": 3})
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    n = Collection(spark.createDataFrame([(1, 100), (2, None), (3, 50)], "id long, score int"))
    assert [r.id for r in n.query({"rank_by": ["score", "desc"]}).collect()] == [1, 3, 2]
    assert [r.id for r in n.query({"rank_by": ["score", "asc"]}).collect()] == [2, 3, 1]


@pytest.mark.parametrize(
    "request_", [{}, {"rank_by": ["id", "up"]}, {"rank_by": ["no", "asc"]}, {"rank_by": ["id", "asc"], "limit": 10001}, {"rank_by": ["id", "asc"], "limit": -1}, {"rank_by": ["id", "asc"], "x": 1},
                 {"rank_by": ["id", "asc"], "aggregate_by": {"n": ["Count"]}}, {"group_by": ["id"]}, {"rank_by": ["id", "asc"], "include_attributes": ["a"], "exclude_attributes": ["b"]}, {"rank_by": ["vector", "ANN", [1.0]]},
                 {"aggregate_by": {"n": ["Avg", "id"]}}, {"aggregate_by": {}}, {"rank_by": ["Sum", "x"]}],
)
def test_malformed(spark, request_):
    with pytest.raises((QueryError, AggregateError, RankError)):
        Collection(spark.createDataFrame([(1, "a")], "id long, t string")).query(request_).collect()


def test_mixed_sums_and_null_group(spark):
    c = Collection(spark.createDataFrame([(1, "A", 10.0), (2, "B", 5.5), (3, None, 4.0)], "id long, k string, v double"))
    assert one(c.query({"aggregate_by": {"s": ["Sum", "v"]}})) == {"s": 19.5}
    assert [r.k for r in c.query({"aggregate_by": {"n": ["Count"]}, "group_by": ["k"]}).collect()] == [None, "A", "B"]


def test_vectors(spark):
    c = Collection(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0])], "id long, vector array<float>"))
    got = c.query({"rank_by": ["vector", "ANN", [1.0, 0.0, 0.0]]}).collect()
    assert [(r.id, r["$dist"]) for r in got[:3]] == [(1, 0.0), (2, 1.0), (4, 1.0)] and got[3].id == 5 and len(got) == 4
    assert decode_vector(encode_vector([1.0, -2.5])) == [1.0, -2.5] and half_to_floats(floats_to_half([0.5, 2.0])) == [0.5, 2.0]
    for bad in ("!!", "AAA="):
        with pytest.raises(VectorError):
            decode_vector(bad)
    with pytest.raises(QueryError):
        Collection(c.df, metric="dot_product")


def test_clustered_search(spark):
    import numpy as np

    x = np.random.default_rng(1).random((400, 8)) - 0.5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>").cache()
    ivf = ann.Ivf.build(df, clusters=16)
    assert ann.recall(ivf, "id", 4, 10, 16)["avg_recall"] == 1.0 and ann.recall(ivf, "id", 4, 10, 12)["avg_recall"] >= 0.7
    assert ann.plan_filtered(0.005, 10).exact and ann.plan_filtered(1.0, 10).candidates == 10
    assert 10 <= ann.plan_filtered(0.8, 10).candidates <= 25 and 40 <= ann.plan_filtered(0.2, 10).candidates <= 60 and 80 <= ann.plan_filtered(0.05, 10).candidates <= 200
    assert ann.widen(ann.plan_filtered(0.2, 10), 3, 10).candidates == 100 and ann.widen(ann.plan_filtered(0.2, 10), 10, 10) is None
    assert ann.cluster_count(100, ann.NEW_CLUSTERS) == 10 and ann.cluster_count(10**9) == 256
    empty = ann.recall(ann.Ivf.build(df.limit(0)), "id")
    assert empty == {"avg_recall": 1.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}


def test_clustered_search_is_exact(spark):
    """vectors without clusters, of which 16 clusters of 44 hold too few of the nearest; then clustered ones, of which few are read."""
    import numpy as np

    rng = np.random.default_rng(3)
    plain = rng.standard_normal((2000, 32))
    plain[7] = 0
    lumps = rng.standard_normal((40, 32))[rng.integers(40, size=2000)] * 3 + 0.01 * plain
    for x, metric, lumped in ((plain, "cosine_distance", False), (plain, "euclidean_squared", False), (plain, "dot_product", False), (lumps, "cosine_distance", True), (lumps, "euclidean_squared", True)):
        df = spark.createDataFrame([(i, int(i % 5), [float(v) for v in r]) for i, r in enumerate(x)], "id long, g int, vector array<float>")
        ivf = ann.Ivf.build(df, metric=metric)
        assert ann.recall(ivf, "id", 5)["avg_recall"] == 1.0
        x = x.astype(np.float32).astype(float)
        for q in (x[11], rng.standard_normal(32)):
            d = np.round(ann.distances(x, q[None], metric)[:, 0], 9)
            order = np.lexsort((np.arange(len(x)), d))
            assert [r.id for r in ivf.search(q.tolist(), 10, "id").collect()] == order[:10].tolist()
            assert [r.id for r in ivf.search_filtered(q.tolist(), 10, "id", F.col("g") < 2).collect()] == [i for i in order if i % 5 < 2][:10]
        if lumped:
            near = ivf.nearest(x[11], 16)
            assert len(ivf.needed(x[11], 0.1, near)) == len(near) < len(ivf.centroids)


DOCS = [
    (1, "The quick brown fox", "A quick brown fox jumps over the lazy dog"), (2, "Hello world", "This is a hello world example"),
    (3, "Another document", "This document does not contain the search term"), (4, "Fox story", "The fox fox fox appears many times in this fox document"),
]


def test_full_text(spark):
    c = Collection(spark.createDataFrame(DOCS, "id long, title string, content string"))
    got = c.query({"rank_by": ["content", "BM25", "fox"]}).collect()
    assert [r.id for r in got] == [4, 1] and all(r["$dist"] > 0 for r in got)
    assert [r.id for r in c.query({"rank_by": ["content", "BM25", "jumping foxes"]}).collect()] == [1, 4]  # stems
    assert [r.id for r in c.query({"rank_by": ["content", "BM25", "fox"], "filters": ["id", "Lt", 4]}).collect()] == [1]
    assert c.query({"rank_by": ["content", "BM25", "the of"]}).count() == 0  # stop words only
    both = c.query({"rank_by": ["Sum", [["title", "BM25", "fox"], ["content", "BM25", "fox"]]]}).collect()
    assert [r.id for r in both] == [4, 1]
    boost = c.query({"rank_by": ["Sum", [["content", "BM25", "fox"], ["Product", 9, ["id", "Eq", 2]]]]}).collect()
    assert boost[0].id == 2 and boost[0]["$dist"] == 9.0
    prefix = c.query({"rank_by": ["content", "BM25", {"query": "hello wor", "last_as_prefix": True}]}).collect()
    assert [r.id for r in prefix] == [2] and prefix[0]["$dist"] > 1
    with pytest.raises(FilterError):
        c.query({"rank_by": ["Max", [["id"]]]}).collect()


def test_postings_by_parts(spark, monkeypatch):
    """postings count a bounded number of tokens at once; documents longer than that stay whole."""
    import pyarrow as pa

    from quern.operators import text_rank

    lists = [["a", "b", "a"], [], ["c"] * 9, ["a"], ["b", "b"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], ["key", "tokens"])
    cut = list(text_rank.parts(batch, 4))
    assert [p.column(1).to_pylist() for p in cut] == [lists[:2], lists[2:3], lists[3:]] and list(text_rank.parts(batch.slice(0, 0), 4)) == []
    assert max(len(p.column(1).flatten()) for p in cut if p.num_rows > 1) <= 4
    df = spark.createDataFrame([(i, None if i == 4 else " ".join(x)) for i, x in enumerate(lists * 40)], "id int, t string").coalesce(1)
    made = lambda: sorted(map(tuple, text_rank.postings(df, "id", "t", Fts(stemming=False, remove_stopwords=False)).collect()), key=str)
    want = made()
    monkeypatch.setattr(text_rank.parts, "__defaults__", (5,))
    assert made() == want and (None, 1, 0, 0) in want and ("c", 2, 9, 9) in want and not any(r[1] == 4 for r in want)


def test_stemmed_counts_send_few_tokens(spark):
    """only tokens that begin like a term of the query are stemmed; counts are those of stemming all of them."""
    from collections import Counter

    from quern.functions.stemming import STEMMERS
    from quern.operators import text_rank

    texts = ["Losers lose; a LOSER is losing", "Young 'young younger yes", "’loser 'losers lo", "", None, "dying dye yourself Ärger ärgern", *[f"loser w{i} disgusted" for i in range(50)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    for fts in (Fts(), Fts("whitespace"), Fts("whitespace", case_sensitive=True), Fts(language="swedish"), Fts(language="norwegian")):
        step = STEMMERS[fts.language]
        c = text_rank.Counts("t", fts, "c")
        c.add(Counter(step(x) for x in ("losers", "young", "dying", "disgusting")), "yo")
        c.add(Counter(["ärg"]), None)
        for r in df.select("id", tokenize(F.col("t"), fts).alias("tokens"), c.column().alias("c")).collect():
            want = None if r.tokens is None else Counter(map(step, r.tokens))
            assert (r.c and r.c.asDict()) == (want if want is None else {"dl": len(r.tokens), **{f"t{i}": want[x] for x, i in c.terms.items()}, "p0": int(any(x.startswith("yo") for x in want))})
    plan = df.select(text_rank.Counts("t", Fts(), "c", {"loser": 0}).column().alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "filter(" in plan.split("ArrowEvalPython")[1]


@pytest.mark.parametrize(
    "text, fts, want",
    [
        ("Hello, World! How are you?", {}, ["hello", "world", "how", "are", "you"]), ("user_id field_name", {}, ["user_id", "field_name"]), ("café résumé", {}, ["café", "résumé"]),
        ("café résumé", {"ascii_folding": True}, ["cafe", "resume"]), ("!@#$%", {}, []), ("a  b", {"tokenizer": "whitespace"}, ["a", "b"]), ("a b", {"tokenizer": "character"}, ["a", "b"]),
        ("ab cd", {"tokenizer": "ngram"}, ["abc", "bcd"]), ("ab", {"tokenizer": "ngram"}, ["ab"]), ("", {"tokenizer": "ngram"}, []), ("The Cat", {"remove_stopwords": True}, ["cat"]), ("AbC", {"case_sensitive": True}, ["AbC"]),
    ],
)
def test_tokenizers(spark, text, fts, want):
    settings = Fts(**{"stemming": False, "remove_stopwords": False, **fts})
    assert spark.createDataFrame([(text,)], "t string").select(tokenize_col(settings)).collect()[0][0] == want == terms_of(text, settings)


def tokenize_col(settings):
    from pyspark.sql import functions as F

    return tokenize(F.col("t"), settings)


def test_settings():
    assert Fts.parse(True) == Fts() and Fts.parse(False) is None
    for bad in ({"k1": 11}, {"b": 2}, {"tokenizer": "x"}, {"language": "x"}, {"no": 1}, 3):
        with pytest.raises(FtsError):
            Fts.parse(bad)


def test_stemmers():
    words = {
        "consistency": "consist", "knightly": "knight", "running": "run", "caresses": "caress", "ties": "tie", "cries": "cri", "hopping": "hop", "hoping": "hope", "relational": "relat", "generously": "generous", "sky": "sky", "news": "news",
        "luxuriated": "luxuri", "hopeful": "hope", "falling": "fall", "agreed": "agre", "happily": "happili",
    }
    assert {w: english(w) for w in words} == words
    assert [swedish(w) for w in ("jaktkarlarne", "klokheten", "friskt")] == ["jaktkarl", "klok", "frisk"]
    assert [norwegian(w) for w in ("havnedistriktene", "opning", "havnemyndighetene")] == ["havnedistrikt", "opning", "havnemynd"]


def test_multi_query(spark):
    c = Collection(spark.createDataFrame(DOCS, "id long, title string, content string"))
    a, b = c.multi_query([{"aggregate_by": {"n": ["Count"]}}, {"rank_by": ["id", "desc"], "limit": 1}])
    assert a.collect()[0].n == 4 and b.collect()[0].id == 4
    with pytest.raises(QueryError):
        c.multi_query([{"aggregate_by": {"n": ["Count"]}}] * 17)
