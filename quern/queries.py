"""Registered queries over the driver's tables and their SQL, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.textproc import Fts, tokenize
from quern.functions.vectors import encode_vector
from quern.operators import ann, ordering, text_rank
from quern.plans.query import Collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
KEYS = {"lineitem": LINE_KEY, "orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "customer": "c_custkey", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}
#: Every full-text query here keeps words as they are, since SQL has no stemmer.
PLAIN = Fts(stemming=False, remove_stopwords=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str, **how) -> Collection:
    return Collection(table(spark, sf_dir, name), KEYS[name], **how)


def _register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# -- filters: a prepared table, a filter, the columns shown, the SQL condition

_PREPARED = {
    "lineitem": (lambda df: df, "lineitem"),
    "orders": (lambda df: df.withColumn("prio", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))), "(SELECT *, nullif(o_orderpriority, '1-URGENT') AS prio FROM orders)"),
    "part": (
        lambda df: df.withColumn("words", F.when(F.col("p_size") != 7, F.split("p_name", " "))).withColumn("sizes", F.when(F.col("p_size") != 7, F.array(F.col("p_size").cast("long"), F.length("p_name").cast("long")))).withColumn("big", F.when(F.col("p_size") != 7, F.col("p_size") > 25)),
        "(SELECT *, CASE WHEN p_size <> 7 THEN string_split(p_name, ' ') END AS words, CASE WHEN p_size <> 7 THEN [p_size::BIGINT, length(p_name)] END AS sizes, CASE WHEN p_size <> 7 THEN p_size > 25 END AS big FROM part)",
    ),
    "events": (lambda df: df, "events"),
    "pages": (lambda df: df, "pages"),
}
_SHOWN = {"lineitem": [*LINE_KEY, "l_quantity", "l_returnflag"], "orders": ["o_orderkey", "prio", "o_totalprice"], "part": ["p_partkey", "p_name", "p_type", "p_size"], "events": ["event_id", "event_type", "ts"], "pages": ["page_id", "url"]}


def _filter(name: str, source: str, filters: list, condition: str) -> None:
    make, sql = _PREPARED[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Collection(make(table(spark, sf_dir, source)), KEYS[source]).where(filters).select(_SHOWN[source])

    _register(f"flt_{name}", run, f"SELECT {', '.join(_SHOWN[source])} FROM {sql} t WHERE {condition}")


_WORDS = "' ' || regexp_replace(translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g') || ' '"
for _args in [
    ("eq", "lineitem", ["l_returnflag", "Eq", "R"], "l_returnflag = 'R'"),
    ("noteq_null", "orders", ["prio", "NotEq", "2-HIGH"], "prio IS DISTINCT FROM '2-HIGH'"),
    ("eq_null", "orders", ["prio", "Eq", None], "prio IS NULL"),
    ("noteq_null_operand", "orders", ["prio", "NotEq", None], "prio IS NOT NULL"),
    ("in", "lineitem", ["l_returnflag", "In", ["A", "R"]], "l_returnflag IN ('A', 'R')"),
    ("in_null", "orders", ["prio", "In", ["2-HIGH", None]], "prio = '2-HIGH' OR prio IS NULL"),
    ("notin_null", "orders", ["prio", "NotIn", ["2-HIGH", "5-LOW"]], "coalesce(prio NOT IN ('2-HIGH', '5-LOW'), true)"),
    ("notin_null_operand", "orders", ["prio", "NotIn", ["2-HIGH", None]], "prio <> '2-HIGH' AND prio IS NOT NULL"),
    ("id_lookup", "orders", ["o_orderkey", "Eq", 7], "o_orderkey = 7"),
    ("lt", "lineitem", ["l_quantity", "Lt", 5], "l_quantity < 5"),
    ("lte", "lineitem", ["l_quantity", "Lte", 5], "l_quantity <= 5"),
    ("gt", "lineitem", ["l_quantity", "Gt", 48], "l_quantity > 48"),
    ("gte", "lineitem", ["l_quantity", "Gte", 48], "l_quantity >= 48"),
    ("lt_null", "orders", ["prio", "Lt", "3"], "coalesce(prio < '3', false)"),
    ("and", "lineitem", ["And", [["l_quantity", "Gt", 45], ["l_returnflag", "Eq", "R"]]], "l_quantity > 45 AND l_returnflag = 'R'"),
    ("or", "lineitem", ["Or", [["l_quantity", "Lt", 2], ["l_returnflag", "Eq", "A"]]], "l_quantity < 2 OR l_returnflag = 'A'"),
    ("or_empty", "orders", ["Or", []], "true"),
    ("and_empty", "orders", ["And", []], "true"),
    ("not", "orders", ["Not", ["Or", [["prio", "Lt", "3"], ["o_totalprice", "Gt", 100000]]]], "NOT (coalesce(prio < '3', false) OR o_totalprice > 100000)"),
    ("contains", "part", ["sizes", "Contains", 12], "coalesce(list_contains(sizes, 12), false)"),
    ("notcontains", "part", ["sizes", "NotContains", 12], "NOT coalesce(list_contains(sizes, 12), false)"),
    ("containsany", "part", ["sizes", "ContainsAny", [11, 12]], "coalesce(list_has_any(sizes, [11, 12]), false)"),
    ("notcontainsany", "part", ["sizes", "NotContainsAny", [11, 12]], "NOT coalesce(list_has_any(sizes, [11, 12]), false)"),
    ("anylt", "part", ["sizes", "AnyLt", 5], "coalesce(list_min(sizes) < 5, false)"),
    ("anylte", "part", ["sizes", "AnyLte", 5], "coalesce(list_min(sizes) <= 5, false)"),
    ("anygt", "part", ["sizes", "AnyGt", 40], "coalesce(list_max(sizes) > 40, false)"),
    ("anygte", "part", ["sizes", "AnyGte", 40], "coalesce(list_max(sizes) >= 40, false)"),
    ("glob", "part", ["p_type", "Glob", "*[A-M]??*"], "regexp_matches(p_type, '^(?s:.*)[A-M](?s:..)(?s:.*)$')"),
    ("glob_prefix", "part", ["p_name", "Glob", "s*"], "starts_with(p_name, 's')"),
    ("notglob", "part", ["p_type", "NotGlob", "*E*"], "NOT regexp_matches(p_type, '^(?s:.*)E(?s:.*)$')"),
    ("iglob", "part", ["p_name", "IGlob", "*ED*[f-h]?*"], "regexp_matches(lower(p_name), '^(?s:.*)ed(?s:.*)[f-h](?s:.)(?s:.*)$')"),
    ("notiglob", "part", ["p_name", "NotIGlob", "*ED*[f-h]?*"], "NOT regexp_matches(lower(p_name), '^(?s:.*)ed(?s:.*)[f-h](?s:.)(?s:.*)$')"),
    ("regex", "pages", ["url", "Regex", "[[:digit:]]{2}"], "regexp_matches(url, '[[:digit:]]{2}')"),
    ("notregex", "pages", ["url", "NotRegex", "[[:digit:]]{2}"], "NOT regexp_matches(url, '[[:digit:]]{2}')"),
    ("tokenseq", "pages", ["url", "ContainsTokenSequence", "EXAMPLE net/en"], f"contains({_WORDS.replace('p_type', 'url')}, ' example net en ')"),
    ("alltokens", "part", ["p_name", "ContainsAllTokens", ["WIDGET", "Red"]], f"contains({_WORDS.replace('p_type', 'p_name')}, ' red ') AND contains({_WORDS.replace('p_type', 'p_name')}, ' widget ')"),
    ("tokens_prefix", "part", ["p_type", "ContainsTokenSequence", {"query": "s", "last_as_prefix": True}], f"contains({_WORDS}, ' s')"),
    ("datetime", "events", ["ts", "Gte", "2024-01-15T12:30:00+01:00"], "ts >= TIMESTAMP '2024-01-15 11:30:00'"),
    ("bool", "part", ["big", "Eq", False], "coalesce(NOT big, false)"),
    ("bool_order", "part", ["big", "Lt", True], "coalesce(big < true, false)"),
]:
    _filter(*_args)


# -- order, limits, pages, projections


def _request(name: str, source: str, request: dict, sql: str, make: Callable[[DataFrame], DataFrame] = lambda df: df, rename: str | None = None, decimals: int | None = None, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Collection(make(table(spark, sf_dir, source)), KEYS[source], **how).query(request)
        if rename:
            score = F.col("`$dist`")
            out = out.withColumn(rename, F.round(score, decimals) if decimals is not None else score).drop("$dist")
        return out

    _register(name, run, sql)


_LINE = ", ".join(LINE_KEY)
_MATCHING = (lambda df: df.withColumn("prio", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))))
_request("ord_asc", "lineitem", {"rank_by": ["l_extendedprice", "asc"], "limit": 20, "include_attributes": ["l_extendedprice"]}, f"SELECT {_LINE}, l_extendedprice FROM lineitem ORDER BY l_extendedprice, {_LINE} LIMIT 20")
_request("ord_desc_nulls", "orders", {"rank_by": ["prio", "desc"], "limit": 10000, "filters": ["o_totalprice", "Gt", 150000], "include_attributes": ["prio"]}, "SELECT o_orderkey, prio FROM (SELECT *, nullif(o_orderpriority, '1-URGENT') AS prio FROM orders) WHERE o_totalprice > 150000 ORDER BY prio DESC NULLS LAST, o_orderkey LIMIT 10000", _MATCHING)
_request("ord_asc_nulls", "orders", {"rank_by": ["prio", "asc"], "limit": 500, "include_attributes": ["prio"]}, "SELECT o_orderkey, prio FROM (SELECT *, nullif(o_orderpriority, '1-URGENT') AS prio FROM orders) ORDER BY prio NULLS FIRST, o_orderkey LIMIT 500", _MATCHING)
_request("ord_id", "customer", {"rank_by": ["c_custkey", "desc"], "limit": 30}, "SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 30")
_request("limit_topk", "customer", {"rank_by": ["c_acctbal", "desc"], "limit": 3, "top_k": 7}, "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
_request("per_one", "customer", {"rank_by": ["c_acctbal", "desc"], "limit": 3, "per": ["c_mktsegment"]}, "SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
_request("per_many", "customer", {"rank_by": ["c_acctbal", "asc"], "limit": 2, "per": ["c_mktsegment", "c_nationkey"]}, "SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal, c_custkey) <= 2")
_register("export_page", lambda spark, d: ordering.page(table(spark, d, "orders"), "o_orderkey", 1000, 500), "SELECT * FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
_request("project_include", "orders", {"rank_by": ["o_totalprice", "desc"], "limit": 50, "include_attributes": ["o_orderdate"]}, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
_request("project_exclude", "orders", {"rank_by": ["o_totalprice", "desc"], "limit": 50, "exclude_attributes": ["o_orderdate", "o_orderkey"]}, "SELECT * EXCLUDE (o_orderdate) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")

FLAGSHIP = {"filters": ["And", [["l_quantity", "Gt", 45], ["l_returnflag", "Eq", "R"]]], "rank_by": ["l_extendedprice", "desc"], "limit": 10, "include_attributes": ["l_extendedprice", "l_quantity"]}
_request("flagship", "lineitem", FLAGSHIP, f"SELECT {_LINE}, l_extendedprice, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' ORDER BY l_extendedprice DESC, {_LINE} LIMIT 10")


# -- aggregates


def _rounded(name: str, source: str, request: dict, sql: str, sums: list[str], make: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Collection(make(table(spark, sf_dir, source)), KEYS[source]).query(request)
        return out.withColumns({c: F.round(c, 2) for c in sums})

    _register(name, run, sql)


_rounded("agg_count", "lineitem", {"aggregate_by": {"n": ["Count"]}}, "SELECT count(*) AS n FROM lineitem", [])
_rounded("agg_sum", "lineitem", {"aggregate_by": {"s": ["Sum", "l_extendedprice"]}}, "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem", ["s"])
_rounded("agg_sum_empty", "lineitem", {"aggregate_by": {"s": ["Sum", "l_tax"], "n": ["Count"]}, "filters": ["l_quantity", "Lt", 0]}, "SELECT coalesce(round(sum(l_tax), 2), 0.0) AS s, count(*) AS n FROM lineitem WHERE l_quantity < 0", ["s"])
_rounded("agg_sum_text", "lineitem", {"aggregate_by": {"s": ["Sum", "l_returnflag"]}}, "SELECT 0.0::DOUBLE AS s", [])
_rounded("agg_multi", "lineitem", {"aggregate_by": {"n": ["Count"], "q": ["Sum", "l_quantity"], "p": ["Sum", "l_extendedprice"]}, "filters": ["l_returnflag", "Eq", "R"]}, "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem WHERE l_returnflag = 'R'", ["q", "p"])
_rounded("grp_one", "lineitem", {"aggregate_by": {"n": ["Count"], "q": ["Sum", "l_quantity"]}, "group_by": ["l_returnflag"]}, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 10", ["q"])
_rounded("grp_many", "lineitem", {"aggregate_by": {"n": ["Count"]}, "group_by": ["l_returnflag", "l_linestatus", "l_linenumber"], "limit": 100}, "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 100", [])
_rounded("grp_null", "orders", {"aggregate_by": {"n": ["Count"]}, "group_by": ["prio"]}, "SELECT nullif(o_orderpriority, '1-URGENT') AS prio, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 10", [], _MATCHING)
_rounded("grp_limit", "customer", {"aggregate_by": {"n": ["Count"]}, "group_by": ["c_nationkey"]}, "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 LIMIT 10", [])
_rounded("grp_filter", "customer", {"aggregate_by": {"b": ["Sum", "c_acctbal"]}, "group_by": ["c_mktsegment"], "filters": ["c_acctbal", "Gt", 0]}, "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS b FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1 LIMIT 10", ["b"])


# -- vectors

QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_Q = "[" + ", ".join(f"{x}" for x in QUERY_VECTOR) + "]::DOUBLE[]"
_V = "embedding::DOUBLE[]"
_DISTANCE = {"cosine_distance": f"list_cosine_distance({_V}, {_Q})", "euclidean_squared": f"pow(list_distance({_V}, {_Q}), 2)", "dot_product": f"-list_inner_product({_V}, {_Q})"}
for _metric, _name in (("cosine_distance", "vec_cosine"), ("euclidean_squared", "vec_euclid"), ("dot_product", "vec_dot")):
    _request(_name, "embeddings", {"rank_by": ["vector", "ANN", QUERY_VECTOR], "top_k": 20}, f"SELECT vec_id, label, round({_DISTANCE[_metric]}, 6) AS dist FROM embeddings ORDER BY {_DISTANCE[_metric]}, vec_id LIMIT 20", rename="dist", decimals=6, vector="embedding", metric=_metric, allow_dot_product=True)
_request("vec_filtered", "embeddings", {"rank_by": ["vector", "ANN", QUERY_VECTOR], "top_k": 15, "filters": ["label", "In", [2, 5]]}, f"SELECT vec_id, label, round({_DISTANCE['cosine_distance']}, 6) AS dist FROM embeddings WHERE label IN (2, 5) ORDER BY {_DISTANCE['cosine_distance']}, vec_id LIMIT 15", rename="dist", decimals=6, vector="embedding")
_request("vec_base64", "embeddings", {"rank_by": ["vector", "ANN", encode_vector(QUERY_VECTOR)], "top_k": 20}, f"SELECT vec_id, label, round({_DISTANCE['cosine_distance']}, 6) AS dist FROM embeddings ORDER BY {_DISTANCE['cosine_distance']}, vec_id LIMIT 20", rename="dist", decimals=6, vector="embedding")


def _ivf(spark: SparkSession, sf_dir: str) -> ann.Ivf:
    return ann.Ivf.build(table(spark, sf_dir, "embeddings"), "embedding")


def _found(spark: SparkSession, exact: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """Whether a clustered search finds 0.9 of the exact top list at least."""
    return exact.select(key).join(near.select(F.col(key).alias("near")), F.col(key) == F.col("near"), "left").agg((F.count("near") >= 0.9 * F.count(F.lit(1))).alias("found"), F.count(F.lit(1)).alias("wanted"))


def ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, request = table(spark, sf_dir, "embeddings"), {"rank_by": ["vector", "ANN", QUERY_VECTOR], "top_k": 10}
    exact = Collection(df, "vec_id", vector="embedding").query(request)
    return _found(spark, exact, Collection(df, "vec_id", vector="embedding", index=_ivf(spark, sf_dir)).query(request), "vec_id")


def ann_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, request = table(spark, sf_dir, "embeddings"), {"rank_by": ["vector", "ANN", QUERY_VECTOR], "top_k": 10, "filters": ["label", "Lt", 3]}
    exact = Collection(df, "vec_id", vector="embedding").query(request)
    return _found(spark, exact, Collection(df, "vec_id", vector="embedding", index=_ivf(spark, sf_dir)).query(request), "vec_id")


_register("ann_ivf", ann_ivf, "SELECT true AS found, 10 AS wanted")
_register("ann_filtered", ann_filtered, "SELECT true AS found, least(10, count(*)) AS wanted FROM embeddings WHERE label < 3")
_register(
    "ann_full_probe",
    lambda spark, d: _ivf(spark, d).search(QUERY_VECTOR, 10, "vec_id", 1 << 20).select("vec_id", "label", F.round("`$dist`", 6).alias("dist")),
    f"SELECT vec_id, label, round({_DISTANCE['cosine_distance']}, 6) AS dist FROM embeddings ORDER BY {_DISTANCE['cosine_distance']}, vec_id LIMIT 10",
)
_register(
    "ann_clusters",
    lambda spark, d: _ivf(spark, d).assigned.agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("cluster_id") > 1).alias("several"), F.sum((F.col("cluster_id") < 0).cast("long")).alias("without")),
    "SELECT count(*) AS n, true AS several, sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)::BIGINT AS without FROM embeddings",
)


def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ann.recall(_ivf(spark, sf_dir), "vec_id", 20)
    return spark.createDataFrame([(got["avg_recall"] >= 0.9, got["avg_ann_count"], got["avg_exhaustive_count"])], "good boolean, ann double, exhaustive double")


_register("recall_report", recall_report, "SELECT true AS good, 10.0::DOUBLE AS ann, least(10, count(*))::DOUBLE AS exhaustive FROM embeddings")


def plan_recall_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of searches filtered to the labels below each of some bounds; the table is small enough to be its own sample."""
    df = table(spark, sf_dir, "embeddings")
    shares = [(n, ann.selectivity(df, F.col("label") < n, 1)) for n in (0, 1, 2, 5, 10)]
    return spark.createDataFrame([(n, p.exact, p.candidates, p.probes) for n, s in shares for p in [ann.plan_filtered(s, 10)]], "below int, exact boolean, candidates int, probes int")


_register(
    "plan_recall_aware",
    plan_recall_aware,
    """WITH s AS (SELECT below, (SELECT count(*) FROM embeddings WHERE label < below) / (SELECT count(*) FROM embeddings) AS s FROM (VALUES (0), (1), (2), (5), (10)) v(below))
    SELECT below, s < 0.01 AS exact, CASE WHEN s < 0.01 THEN 0 WHEN s >= 1 THEN 10 ELSE greatest(10, floor(10 * least(greatest(1 / s, 2), 10)))::INT END AS candidates,
    CASE WHEN s < 0.01 THEN 0 WHEN s >= 1 THEN 16 ELSE 64 - floor((s - 0.01) / 0.99 * 48)::INT END AS probes FROM s""",
)


# -- text

# characters of a text as a list are made once; windows of three are taken from it
_CHARS = "string_split(lower(replace(text, ' ', '')), '')"
_NGRAMS = f"list_transform([{_CHARS}], lambda c: CASE WHEN len(c) >= 3 THEN list_transform(list_zip(c, c[2:], c[3:], true), lambda z: z[1] || z[2] || z[3]) ELSE [array_to_string(c, '')] END)[1]"
_STOPPED = (
    "the of and to in is it that was for on are with as they at be this from have or by had not but what all were when we can an your which their if will each how do other so no who being "
    "been its where why some any most such only own same than too very just should now also more my i a our me you he has did does"
)
_TOKENS = {
    "tok_word": (PLAIN, r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')"),
    "tok_ws": (Fts("whitespace", stemming=False, remove_stopwords=False), r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"),
    "tok_ngram": (Fts("ngram", stemming=False, remove_stopwords=False), _NGRAMS),
    "tok_char": (Fts("character", stemming=False, remove_stopwords=False), r"regexp_extract_all(lower(text), '[^\s]')"),
    "stop_words": (Fts(stemming=False), r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+'), lambda x: NOT list_contains(string_split('" + _STOPPED + "', ' '), x))"),
}
for _name, (_fts, _sql) in _TOKENS.items():
    _register(
        _name,
        lambda spark, d, fts=_fts: table(spark, d, "documents").select("doc_id", tokenize(F.col("text"), fts).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.concat_ws("|", "t")).alias("digest")),
        f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {_sql} AS t FROM documents)",
    )


def _bm25_sql(terms: list[str], where: str = "true", extra: str = "") -> str:
    parts = []
    for term in dict.fromkeys(terms):
        tf = f"len(list_filter(t, lambda x: x = '{term}'))"
        df = f"(SELECT count(*) FROM d WHERE list_contains(t, '{term}'))"
        parts.append(f"{terms.count(term)} * ln(((SELECT count(*) FROM d) - {df} + 0.5) / ({df} + 0.5) + 1) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(t) / (SELECT avg(len(t)) FROM d)))")
    return " + ".join(parts)


_D = r"d AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+') AS t FROM documents)"


def _text(name: str, rank: list, score: str, limit: int = 25, filters: list | None = None, where: str = "true") -> None:
    request = {"rank_by": rank, "limit": limit, "include_attributes": ["lang"], **({"filters": filters} if filters else {})}
    sql = f"WITH {_D}, s AS (SELECT doc_id, lang, n_chars, source, {score} AS score FROM d) SELECT doc_id, lang, round(score, 4) AS score FROM s WHERE score > 0 AND {where} ORDER BY score DESC, doc_id LIMIT {limit}"
    _request(name, "documents", request, sql, rename="score", decimals=4, fts={"text": PLAIN})


_LONG = "CASE WHEN n_chars > 3000 THEN 1.0 ELSE 0.0 END"
_text("bm25_single", ["text", "BM25", "scum"], _bm25_sql(["scum"]))
_text("bm25_multi", ["text", "BM25", "stupid clown the the"], _bm25_sql(["stupid", "clown", "the", "the"]))
_text("bm25_filtered", ["text", "BM25", "the of"], _bm25_sql(["the", "of"]), filters=["source", "In", ["src1", "src2"]], where="source IN ('src1', 'src2')")
_text("bm25_prefix", ["text", "BM25", {"query": "the thin", "last_as_prefix": True}], f"CASE WHEN list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'thin'))) > 0 THEN {_bm25_sql(['the'])} + 1.0 ELSE 0.0 END")
_text("rank_sum", ["Sum", [["text", "BM25", "the"], ["text", "BM25", "und"]]], f"({_bm25_sql(['the'])}) + ({_bm25_sql(['und'])})")
_text("rank_max", ["Max", [["text", "BM25", "the"], ["text", "BM25", "und"]]], f"greatest({_bm25_sql(['the'])}, {_bm25_sql(['und'])})")
_text("rank_product", ["Product", 2.5, ["text", "BM25", "idiot"]], f"2.5 * ({_bm25_sql(['idiot'])})")
_text("rank_filter_boost", ["Sum", [["text", "BM25", "moron"], ["Product", 0.5, ["n_chars", "Gt", 3000]]]], f"({_bm25_sql(['moron'])}) + 0.5 * {_LONG}")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that rank high by BM25 and by length, fused."""
    docs = collection(spark, sf_dir, "documents", fts={"text": PLAIN})
    text = docs.query({"rank_by": ["text", "BM25", "loser pathetic"], "limit": 50})
    size = docs.query({"rank_by": ["n_chars", "desc"], "limit": 50})
    out = ordering.fuse([text, size], "doc_id", [-F.round("`$dist`", 9), -F.col("n_chars")], limit=20)
    return out.select("doc_id", F.round("`$dist`", 9).alias("score"))


_register(
    "hybrid_rrf",
    hybrid_rrf,
    f"WITH {_D}, s AS (SELECT doc_id, {_bm25_sql(['loser', 'pathetic'])} AS score FROM d), a AS (SELECT doc_id, row_number() OVER (ORDER BY -round(score, 9), doc_id) AS r FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)), "
    "b AS (SELECT doc_id, row_number() OVER (ORDER BY -n_chars, doc_id) AS r FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) "
    "SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM u GROUP BY 1 ORDER BY sum(1.0 / (60 + r)) DESC, doc_id LIMIT 20",
)
_register("bm25_stemmed", lambda spark, d: collection(spark, d, "documents", fts={"text": Fts()}).query({"rank_by": ["text", "BM25", "disgusting losers"], "limit": 25}).select("doc_id", "lang"))
