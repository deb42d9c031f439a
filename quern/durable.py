"""Registered queries that write to namespaces, and their SQL over the source table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.namespace import Engine
from quern.sources.scratch import shared
from quern.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BASE = "b AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def _case(name: str, steps: Callable[[Engine, DataFrame], None], sql: str) -> None:
    """A namespace `ns` filled from orders, changed by `steps`, and its snapshot."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, rows = Engine(spark, shared(spark, "namespaces")), _orders(spark, sf_dir)
        engine.write("ns", upsert=rows)
        steps(engine, rows)
        return engine.snapshot("ns").select("id", "cust", "status", "price")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_BASE} {sql}"


def _lww(e: Engine, rows: DataFrame) -> None:
    e.write("ns", upsert=rows.where("id % 10 = 0").withColumn("price", F.col("price") + 1))
    e.write("ns", upsert=rows.where("id % 20 = 0").select(F.col("id") + 10_000_000, "cust", "status", "price").toDF("id", "cust", "status", "price"))


_case("upsert_lww", _lww, "SELECT id, cust, status, CASE WHEN id % 10 = 0 THEN price + 1 ELSE price END AS price FROM b UNION ALL SELECT id + 10000000, cust, status, price FROM b WHERE id % 20 = 0")


def _patch(e: Engine, rows: DataFrame) -> None:
    e.write("ns", patch=rows.where("id % 7 = 0").select("id", F.lit("X").alias("status")))
    e.write("ns", patch=[{"id": 99_999_999, "status": "Y"}])
    e.write("ns", patch=rows.where("id % 14 = 0").select("id", F.lit(None).cast("double").alias("price")))


_case("patch_merge", _patch, "SELECT id, cust, CASE WHEN id % 7 = 0 THEN 'X' ELSE status END AS status, CASE WHEN id % 14 = 0 THEN NULL ELSE price END AS price FROM b")
_case("delete_tombstone", lambda e, rows: e.write("ns", deletes=rows.where("id % 5 = 0").select("id")), "SELECT id, cust, status, price FROM b WHERE id % 5 <> 0")
_case("delete_by_filter", lambda e, rows: e.write("ns", delete_by_filter=["price", "Lt", 150000], whole=True), "SELECT id, cust, status, price FROM b WHERE NOT price < 150000")
_case("patch_by_filter", lambda e, rows: e.write("ns", patch_by_filter={"filters": ["status", "Eq", "O"], "patch": {"status": "Z", "price": None}}, whole=True), "SELECT id, cust, CASE WHEN status = 'O' THEN 'Z' ELSE status END AS status, CASE WHEN status = 'O' THEN NULL ELSE price END AS price FROM b")


def _cond_upsert(e: Engine, rows: DataFrame) -> None:
    new = rows.where("id % 3 = 0").withColumn("price", F.lit(1.0)).union(rows.where("id % 30 = 0").select(F.col("id") + 10_000_000, "cust", "status", "price"))
    e.write("ns", upsert=new, upsert_condition=["price", "Lt", 200000])


_case("cond_upsert", _cond_upsert, "SELECT id, cust, status, CASE WHEN id % 3 = 0 AND price < 200000 THEN 1.0 ELSE price END AS price FROM b UNION ALL SELECT id + 10000000, cust, status, price FROM b WHERE id % 30 = 0")
_case("cond_patch", lambda e, rows: e.write("ns", patch=rows.select("id", F.lit("P").alias("status")), patch_condition=["price", "Gte", 200000]), "SELECT id, cust, CASE WHEN price >= 200000 THEN 'P' ELSE status END AS status, price FROM b")
_case("cond_delete", lambda e, rows: e.write("ns", deletes=rows.where("id % 2 = 0").select("id"), delete_condition=["status", "NotEq", "F"]), "SELECT id, cust, status, price FROM b WHERE NOT (id % 2 = 0 AND status <> 'F')")
_case("ref_new", lambda e, rows: e.write("ns", upsert=rows.withColumn("price", F.lit(150000.0)), upsert_condition=["price", "Lt", "$ref_new.price"]), "SELECT id, cust, status, greatest(price, 150000.0) AS price FROM b")


def _phases(e: Engine, rows: DataFrame) -> None:
    e.write(
        "ns", delete_by_filter=["status", "Eq", "P"], patch_by_filter={"filters": ["status", "Eq", "O"], "patch": {"status": "N"}}, upsert=rows.where("status = 'P' and id % 2 = 0").withColumn("price", F.lit(0.0)),
        patch=rows.where("id % 4 = 0").select("id", F.lit(7).cast("long").alias("cust")), deletes=rows.where("id % 8 = 0").select("id"), whole=True,
    )


_case("phase_order", _phases, "SELECT id, CASE WHEN id % 4 = 0 THEN 7 ELSE cust END AS cust, CASE WHEN status = 'O' THEN 'N' ELSE status END AS status, CASE WHEN status = 'P' THEN 0.0 ELSE price END AS price FROM b WHERE (status <> 'P' OR id % 2 = 0) AND id % 8 <> 0")


def _tail(e: Engine, rows: DataFrame) -> None:
    e.write("ns", deletes=rows.where("id % 6 = 0").select("id"))
    e.index("ns")
    e.write("ns", patch=rows.where("id % 5 = 0").select("id", F.lit("T").alias("status")))
    e.write("ns", upsert=rows.where("id % 12 = 0"))


_TAIL_SQL = "SELECT id, cust, CASE WHEN id % 5 = 0 AND id % 6 <> 0 THEN 'T' ELSE status END AS status, price FROM b WHERE id % 6 <> 0 OR id % 12 = 0"


def _compact(e: Engine, rows: DataFrame) -> None:
    _tail(e, rows)
    e.index("ns")
    e.compact("ns")
    e.vacuum("ns", retention=0)


_case("snapshot_tail", _tail, _TAIL_SQL)
_case("compact_equiv", _compact, _TAIL_SQL)


def copy_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, shared(spark, "namespaces"))
    engine.write("from", upsert=_orders(spark, sf_dir))
    engine.write("from", delete_by_filter=["status", "Eq", "F"], whole=True)
    engine.write("to", copy_from="from", upsert=[{"id": 3, "status": "own"}])
    return engine.query("to", {"aggregate_by": {"n": ["Count"]}, "group_by": ["status"]})


QUERIES["copy_ns"] = copy_ns
ORACLES["copy_ns"] = f"WITH {_BASE}, c AS (SELECT id, status FROM b WHERE status <> 'F' AND id <> 3 UNION ALL SELECT 3, 'own') SELECT status, count(*) AS n FROM c GROUP BY 1"


def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, shared(spark, "namespaces"))
    engine.write("ns", upsert=_orders(spark, sf_dir))
    a, b = engine.multi_query("ns", [{"aggregate_by": {"n": ["Count"]}, "group_by": ["status"]}, {"aggregate_by": {"n": ["Count"]}, "filters": ["price", "Gt", 200000]}])
    return a.union(b.select(F.lit("dear"), "n"))


QUERIES["multi_query"] = multi_query
ORACLES["multi_query"] = f"WITH {_BASE} SELECT status, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'dear', count(*) FROM b WHERE price > 200000"


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a namespace in micro-batches, counted there."""
    folder = shared(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(sf_dir + "/events.parque[t]").select(F.col("event_id").alias("id"), "event_type", "value")
    engine = Engine(spark, f"{folder}/namespaces")
    ingest(engine, "events", stream, f"{folder}/progress", None).awaitTermination()
    out = engine.query("events", {"aggregate_by": {"n": ["Count"], "v": ["Sum", "value"]}, "group_by": ["event_type"]})
    return out.withColumn("v", F.round("v", 2))


QUERIES["stream_ingest"] = stream_ingest
ORACLES["stream_ingest"] = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1 ORDER BY 1 LIMIT 10"


def _text_space(spark: SparkSession, sf_dir: str) -> Engine:
    """Documents in a namespace: an indexed part, then a tail that deletes and replaces."""
    engine = Engine(spark, shared(spark, "namespaces"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    engine.write("ns", upsert=docs, schema={"text": {"type": "string", "full_text_search": {"stemming": False, "remove_stopwords": False}}})
    engine.index("ns")
    engine.write("ns", deletes=docs.where("id % 10 = 3").select("id"), upsert=docs.where("id % 10 = 4").withColumn("text", F.concat(F.lit("scum scum "), "text")))
    return engine


def ns_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the postings of a segment, less what the tail hides, plus what it brings."""
    out = _text_space(spark, sf_dir).query("ns", {"rank_by": ["text", "BM25", "scum the"], "limit": 30, "include_attributes": ["lang"]})
    return out.select("id", "lang", F.round("`$dist`", 4).alias("score"))


QUERIES["ns_bm25"] = ns_bm25
_TF = "len(list_filter(t, lambda x: x = '{0}'))"
_PART = "ln(((SELECT count(*) FROM d) - (SELECT count(*) FROM d WHERE list_contains(t, '{0}')) + 0.5) / ((SELECT count(*) FROM d WHERE list_contains(t, '{0}')) + 0.5) + 1) * " + _TF + " * 2.2 / (" + _TF + " + 1.2 * (0.25 + 0.75 * len(t) / (SELECT avg(len(t)) FROM d)))"
ORACLES["ns_bm25"] = (
    r"WITH d AS (SELECT doc_id AS id, lang, regexp_extract_all(lower(CASE WHEN doc_id % 10 = 4 THEN 'scum scum ' || text ELSE text END), '[\p{L}\p{Nd}_]+') AS t FROM documents WHERE doc_id % 10 <> 3), "
    f"s AS (SELECT id, lang, {_PART.format('scum')} + {_PART.format('the')} AS score FROM d) SELECT id, lang, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 30"
)


def ns_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of a namespace with an indexed part and a tail; the nearest of all come from the tail."""
    engine = Engine(spark, shared(spark, "namespaces"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    engine.write("ns", upsert=rows.where("id % 10 <> 0"), distance_metric="euclidean_squared")
    engine.index("ns")
    engine.write("ns", upsert=rows.where("id % 10 = 0").withColumn("vector", F.expr("transform(vector, x -> cast(x * 0.01 as float))")), deletes=rows.where("id % 10 = 1").select("id"))
    out = engine.query("ns", {"rank_by": ["vector", "ANN", [0.0] * 63 + [0.25]], "top_k": 20, "filters": ["id", "Gte", 0]})
    return out.select("id", "label", F.round("`$dist`", 6).alias("dist"))


QUERIES["ns_vector"] = ns_vector
ORACLES["ns_vector"] = """
    WITH q AS (SELECT list_concat(list_transform(range(63), lambda i: 0.0::DOUBLE), [0.25::DOUBLE]) AS q),
    v AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: (x * 0.01)::FLOAT::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 10 <> 1),
    d AS (SELECT id, label, list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v, q)
    SELECT id, label, round(dist, 6) AS dist FROM d ORDER BY d.dist, id LIMIT 20"""


def eventual_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eventual read sees the indexed part and only the newest entries of the log that fit its cap."""
    engine, rows = Engine(spark, shared(spark, "namespaces")), _orders(spark, sf_dir)
    engine.write("ns", upsert=rows.where("id % 3 = 0"))
    engine.index("ns")
    engine.write("ns", upsert=rows.where("id % 3 = 1"))
    engine.write("ns", upsert=rows.where("id % 3 = 2"))
    state = engine.state("ns")
    state.log[str(state.head)]["bytes"], state.log[str(state.head - 1)]["bytes"] = 1 << 20, 128 << 20  # the older one no longer fits
    return engine.snapshot("ns", "eventual", state).select("id", "cust", "status", "price")


QUERIES["eventual_cap"] = eventual_cap
ORACLES["eventual_cap"] = f"WITH {_BASE} SELECT id, cust, status, price FROM b WHERE id % 3 <> 1"


def _many_phases(e: Engine, rows: DataFrame) -> None:
    wide = rows.repartition(300)  # the order of phases does not hang on that of partitions
    e.write("ns", upsert=wide.withColumn("price", F.lit(1.0)), patch=wide.where("id % 3 = 0").select("id", F.lit("M").alias("status")), deletes=wide.where("id % 5 = 0").select("id"))


_case("phase_order_wide", _many_phases, "SELECT id, cust, CASE WHEN id % 3 = 0 THEN 'M' ELSE status END AS status, 1.0::DOUBLE AS price FROM b WHERE id % 5 <> 0")


def _tiers(e: Engine, rows: DataFrame) -> None:
    for k in range(5):
        e.index("ns")
        e.write("ns", patch=rows.where(f"id % 11 = {k}").select("id", F.lit(float(k)).alias("price")), deletes=rows.where(f"id % 13 = {k}").select("id"))
    e.index("ns")


_case("segment_tiers", _tiers, "SELECT id, cust, status, CASE WHEN id % 11 < 5 THEN (id % 11)::DOUBLE ELSE price END AS price FROM b WHERE id % 13 >= 5")


def string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, shared(spark, "namespaces"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws("/", "p_brand", F.col("p_partkey")).alias("id"), "p_size")
    engine.write("from", upsert=rows)
    engine.write("to", copy_from="from", deletes=rows.where("p_size < 10").select("id"))
    return engine.snapshot("to")


QUERIES["string_ids"] = string_ids
ORACLES["string_ids"] = "SELECT p_brand || '/' || p_partkey AS id, p_size FROM part WHERE p_size >= 10"
