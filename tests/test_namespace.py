import json

import pytest

from quern.sources import namespace as ns_
from quern.sources.namespace import Backpressure, Engine, IndexRebuilding, NamespaceError, capped, fold, infer
from quern.streaming.ingest import index_as_stream, ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fold(spark):
    log = [
        (1, 1, 1, "U", [], "x", 1), (1, 2, 1, "P", ["b"], None, 9), (1, 3, 1, "P", ["a"], None, None), (2, 1, 2, "U", [], "y", 2), (2, 2, 2, "D", [], None, None), (2, 3, 2, "P", ["a"], "z", None),
        (3, 1, 3, "U", [], "x", 1), (3, 1, 4, "D", [], None, None), (3, 1, 5, "U", [], None, 7), (4, 1, 6, "P", ["a"], "q", None),
    ]
    df = spark.createDataFrame([(i, q, 0, *rest) for i, q, *rest in log], "id long, _seq long, _phase int, _pos long, _op string, _present array<string>, a string, b long")
    assert rows(fold(df, "id", ["a", "b"]), "id", "a", "b") == [(1, None, 9), (3, None, 7)]


def test_phases_of_one_request(engine):
    engine.write("n", upsert=[{"id": 1, "name": "toDelete", "v": 100}, {"id": 2, "name": "toPatch", "v": 200}, {"id": 3, "name": "unchanged", "v": 300}])
    r = engine.write(
        "n", delete_by_filter=["name", "Eq", "toDelete"], patch_by_filter={"filters": ["name", "Eq", "toPatch"], "patch": {"by": "filter"}}, upsert=[{"id": 10, "name": "new"}], patch=[{"id": 3, "by": "explicit"}], deletes=[10],
    )
    assert (r.deleted, r.upserted, r.patched) == (2, 1, 2) and r.affected == 5
    assert rows(engine.snapshot("n"), "id", "by", "v") == [(2, "filter", 200), (3, "explicit", 300)]
    engine.index("n")
    assert rows(engine.snapshot("n"), "id", "by", "v") == [(2, "filter", 200), (3, "explicit", 300)]


def test_upserts_patches_conditions(engine):
    engine.write("n", upsert=[{"id": 1, "version": 5, "name": "Original", "extra": "keep"}, {"id": 1, "version": 6, "name": "Last"}])
    assert rows(engine.snapshot("n"), "id", "version", "name", "extra") == [(1, 6, "Last", None)]
    assert engine.write("n", upsert=[{"id": 1, "version": 10}], upsert_condition=["version", "Lt", "$ref_new.version"]).upserted == 1
    assert engine.write("n", upsert=[{"id": 1, "version": 9}], upsert_condition=["version", "Lt", "$ref_new.version"]).upserted == 0
    assert engine.write("n", upsert=[{"id": 2, "version": 1}], upsert_condition=["version", "Lt", "$ref_new.version"]).upserted == 1
    assert engine.write("n", patch=[{"id": 1, "name": "P"}, {"id": 77, "name": "no"}], patch_condition=["version", "Eq", 10]).patched == 1
    assert engine.write("n", deletes=[1, 2, 3], delete_condition=["version", "Eq", "$ref_new.version"]).deleted == 0
    assert engine.write("n", deletes=[1, 2, 3], delete_condition=["version", "Lt", 5]).deleted == 1
    assert rows(engine.snapshot("n"), "id", "version", "name") == [(1, 10, "P")]
    engine.write("n", upsert_columns={"id": [5, 6], "name": ["a", "b"]})
    assert engine.snapshot("n").count() == 3
    for bad in ({"id": [5, 5], "name": ["a", "b"]}, {"id": [5], "name": ["a", "b"]}):
        with pytest.raises(NamespaceError):
            engine.write("n", upsert_columns=bad)


def test_patch_keeps_vector_and_null_overwrites(engine):
    engine.write("n", upsert=[{"id": 1, "vector": [1.0, 0.0], "a": "x", "b": 1}], distance_metric="cosine_distance")
    engine.write("n", patch=[{"id": 1, "a": None}])
    assert rows(engine.snapshot("n"), "id", "a", "b") == [(1, None, 1)]
    assert engine.query("n", {"rank_by": ["vector", "ANN", [1.0, 0.0]]}).collect()[0]["$dist"] == 0.0
    with pytest.raises(NamespaceError):
        engine.write("n", patch=[{"id": 1, "vector": [0.0, 1.0]}])
    with pytest.raises(NamespaceError):
        engine.write("n", upsert=[{"id": 2, "a": "q"}], distance_metric="euclidean_squared")


def test_every_cut_point_reads_alike(engine):
    def history(cut):
        name = f"n{cut}"
        steps = [
            {"upsert": [{"id": i, "a": i, "b": "x"} for i in range(6)]}, {"patch": [{"id": 1, "b": "p"}, {"id": 9, "b": "q"}]}, {"deletes": [2, 3]}, {"upsert": [{"id": 3, "a": 33}]}, {"patch": [{"id": 3, "b": None}, {"id": 0, "a": None}], "deletes": [5]},
        ]
        for i, step in enumerate(steps):
            engine.write(name, **step)
            if i == cut:
                engine.index(name)
        return sorted(map(str, rows(engine.snapshot(name), "id", "a", "b")))

    assert history(0) == history(1) == history(2) == history(3) == history(4) == history(9) == sorted(map(str, [(0, None, "x"), (1, 1, "p"), (3, 33, None), (4, 4, "x")]))


def test_schema_is_inferred_once(engine):
    engine.write("n", upsert=[{"id": "k", "f": 1.5, "d": "2024-01-02T03:04:05Z", "t": ["a"], "flag": True, "none": None, "empty": []}])
    s = engine.state("n").schema
    assert s == {"f": "double", "d": "timestamp", "t": "array<string>", "flag": "boolean"}
    engine.write("n", upsert=[{"id": "m", "f": 2}])
    for bad in ({"id": "q", "t": "text"}, {"id": "q", "$x": 1}, {"id": "q", "f": "no"}, {"id": None}, {"id": "x" * 65}):
        with pytest.raises(NamespaceError):
            engine.write("n", upsert=[bad])
    engine.write("n", schema={"txt": {"type": "string", "full_text_search": True, "regex": True}})
    assert engine.metadata("n")["schema"]["txt"]["regex"] and engine.metadata("n")["approx_row_count"] == 2
    assert infer([None]) is None and infer(1 << 40) == "bigint"


def test_rebuild_gate(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", strict_rebuild_gating=True)
    e.write("n", upsert=[{"id": 1, "t": "a fox"}])
    e.write("n", schema={"t": {"type": "string", "full_text_search": True}})
    with pytest.raises(IndexRebuilding):
        e.query("n", {"rank_by": ["t", "BM25", "fox"]})
    e.index("n")
    assert e.query("n", {"rank_by": ["t", "BM25", "fox"]}).count() == 1


def test_copy_list_delete_vacuum(engine):
    engine.write("a", upsert=[{"id": 1, "x": 1}, {"id": 2, "x": 2}])
    engine.write("b", copy_from="a", deletes=[2])
    assert rows(engine.snapshot("b"), "id", "x") == [(1, 1)]
    assert engine.namespaces() == (["a", "b"], None) and engine.namespaces(page_size=1) == (["a"], "a") and engine.namespaces(cursor="a") == (["b"], None)
    engine.index("a")
    engine.write("a", upsert=[{"id": 3, "x": 3}])
    engine.index("a")
    assert engine.vacuum("a") == [] and len(engine.vacuum("a", retention=0)) >= 3 and engine.snapshot("a").count() == 3
    engine.delete("a", purge=True)
    with pytest.raises(NamespaceError):
        engine.snapshot("a")
    engine.delete("b")
    with pytest.raises(NamespaceError):
        engine.write("b", upsert=[{"id": 1}])
    with pytest.raises(NamespaceError):
        engine.write("bad/name", upsert=[{"id": 1}])


def test_consistency_caps_and_idempotency(engine, monkeypatch):
    engine.write("n", upsert=[{"id": 1, "x": 1}])
    assert engine.snapshot("n", "eventual").count() == 1
    engine.write("n", upsert=[{"id": 2, "x": 2}])
    assert engine.snapshot("n", {"level": "eventual"}).count() == 1 and engine.snapshot("n").count() == 2  # the stale state is still young
    assert capped({"1": 10, "2": 10, "3": 10}, 0, 3, 25) == 1 and capped({"1": 10}, 0, 1, 25) == 0 and capped({"5": 99}, 4, 5, 25) == 5
    first = engine.write("n", upsert=[{"id": 3, "x": 3}], request_id="r")
    again = Engine(engine.spark, engine.root)  # a driver that started anew
    assert again.write("n", upsert=[{"id": 4, "x": 4}], request_id="r") == first and engine.snapshot("n").count() == 3
    monkeypatch.setattr(ns_, "UNINDEXED_BYTES", 1)
    with pytest.raises(Backpressure):
        engine.write("n", upsert=[{"id": 9}])
    assert engine.write("n", upsert=[{"id": 9, "x": 9}], disable_backpressure=True).upserted == 1
    monkeypatch.setattr(ns_, "MOST_DELETED", 1)
    with pytest.raises(NamespaceError):
        engine.write("n", delete_by_filter=["x", "Gt", 0], disable_backpressure=True)
    assert engine.write("n", delete_by_filter=["x", "Gt", 0], allow_partial=True, disable_backpressure=True).remaining


def test_whole_filters_have_no_limit(spark, sf_dir, monkeypatch):
    """9,000,000 orders have 3,000,000 of one status, over the 500,000 that one request may patch."""
    from quern.durable import QUERIES

    want = {n: sorted(QUERIES[n](spark, sf_dir).collect(), key=str) for n in ("patch_by_filter", "phase_order", "delete_by_filter", "copy_ns")}
    monkeypatch.setattr(ns_, "MOST_DELETED", 10)
    monkeypatch.setattr(ns_, "MOST_PATCHED", 10)
    for n, rows in want.items():
        assert sorted(QUERIES[n](spark, sf_dir).collect(), key=str) == rows and rows


def test_segments_fold_once(engine, spark, monkeypatch):
    """the first segment of one write is not folded, an upper one is one aggregation by key and no join."""
    kept = ns_.fold
    monkeypatch.setattr(ns_, "fold", None)
    engine.write("n", upsert=spark.range(20).selectExpr("id", "id % 3 as x", "'a' as y"))
    assert engine.snapshot("n").count() == 20
    engine.index("n")
    monkeypatch.setattr(ns_, "fold", kept)
    engine.write("n", patch=[{"id": 1, "x": 70}, {"id": 50, "x": 1}, {"id": 2, "x": 8}], deletes=[2, 3, 60])
    s = engine.state("n")
    df = ns_.changed(engine._changes("n", s)[0], "id", list(s.schema), s.indexed)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 70, "a", False), (2, None, None, True), (3, None, None, True), (60, None, None, True)], key=str)
    old = engine._changes("n", s)[0]
    assert ns_.changed(old, "id", ["x"], s.head).count() == 0
    engine.index("n")
    assert {(r.id, r.x, r.y) for r in engine.snapshot("n").collect()} == {(i, 70 if i == 1 else i % 3, "a") for i in range(20) if i not in (2, 3)}
    engine.write("m", upsert=[{"id": 1, "x": 1}], deletes=[1])  # two phases of one write repeat a key
    assert engine.snapshot("m").count() == 0


def test_leftovers_of_a_dead_writer(engine):
    engine.write("n", upsert=[{"id": 1, "x": 1}])
    before = engine.state("n")
    engine.write("n", upsert=[{"id": 2, "x": 2}])
    fs, p = engine.files._at(engine.path("n", "state", f"{before.version + 1:012d}.json"))
    fs.delete(p, False)  # as if the writer had died before its commit
    assert engine.snapshot("n").count() == 1
    assert engine.repair("n") == 2 and engine.snapshot("n").count() == 2  # its entry follows the head
    assert engine.files.create(engine.path("n", "state", f"{before.version + 2:012d}.json"), "{")  # half a commit
    assert engine.repair("n") == 2 and engine.write("n", upsert=[{"id": 3, "x": 3}]).seq == 3
    stale = engine.state("n")
    engine.write("n", upsert=[{"id": 4, "x": 4}])
    assert not engine._commit("n", stale)  # another writer came first


def test_two_writers(engine, spark, monkeypatch):
    """A writer that loses the race between its log and its commit tries again; neither's rows are lost."""
    engine.write("n", upsert=[{"id": 1, "x": 1}])
    other, real, raced = Engine(spark, engine.root), engine.files.create, []

    def create(path, text):
        if path.endswith(".json") and "/state/" in path and not raced:
            raced.append(other.write("n", upsert=[{"id": 2, "x": 2}]))
        return real(path, text)

    monkeypatch.setattr(engine.files, "create", create)
    assert engine.write("n", upsert=[{"id": 3, "x": 3}]).seq == 3 and raced[0].seq == 2
    assert rows(engine.snapshot("n"), "id", "x") == [(1, 1), (2, 2), (3, 3)]


def test_phases_hold_beyond_127_partitions(engine, spark):
    df = spark.range(3000).selectExpr("id", "id as x").repartition(300)
    engine.write("n", upsert=df, deletes=df.select("id"))
    assert engine.snapshot("n").count() == 0
    engine.write("n", upsert=df.withColumn("x", df.x + 1), patch=df.select("id").withColumn("y", df.id))
    assert engine.snapshot("n").where("x = id + 1 and y = id").count() == 3000


def test_string_ids_from_frames_and_copies(engine, spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x long")
    engine.write("n", upsert=df)
    engine.write("n", patch=[{"id": "a", "x": 5}], deletes=["b"])
    engine.write("m", copy_from="n", upsert=[{"id": "z", "x": 9}])
    assert rows(engine.snapshot("n"), "id", "x") == [("a", 5)] and rows(engine.snapshot("m"), "id", "x") == [("a", 5), ("z", 9)]
    with pytest.raises(NamespaceError):
        engine.write("q", upsert=[{"id": 1}]) and engine.write("q", upsert=df)
    df.write.json(f"{tmp_path}/json")
    ingest(engine, "s", spark.readStream.schema("id string, x long").json(f"{tmp_path}/json"), f"{tmp_path}/c", None).awaitTermination()
    assert engine.snapshot("s").count() == 2
    u = "0A1B2C3D-0000-1111-2222-333344445555"
    engine.write("u", upsert=[{"id": u, "x": 1}, {"id": u.replace("-", "").lower(), "x": 2}])
    engine.write("u", patch=spark.createDataFrame([(u.replace("-", ""), 7)], "id string, y long"))
    assert rows(engine.snapshot("u"), "id", "x", "y") == [(u.lower(), 2, 7)]


def test_segments_and_tiers(engine, spark):
    engine.write("n", upsert=spark.range(1000).selectExpr("id", "id as x", "cast(id as string) as t"))
    engine.index("n")
    want = {i: i for i in range(1000)}
    for k in range(1, 10):
        engine.write("n", upsert=[{"id": 10 * k, "x": -k}], deletes=[10 * k + 1])
        engine.write("n", patch=[{"id": 10 * k + 2, "x": -k}, {"id": 5000, "x": 1}])
        want |= {10 * k: -k, 10 * k + 2: -k}
        want.pop(10 * k + 1)
        engine.index("n")
        assert dict(rows(engine.snapshot("n"), "id", "x")) == want
    levels = [x["level"] for x in engine.state("n").segments]
    assert levels == [2, 1, 1, 0] and engine.metadata("n")["approx_row_count"] >= len(want)
    plan = engine.snapshot("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
    engine.compact("n")
    assert [x["level"] for x in engine.state("n").segments] == [2] and dict(rows(engine.snapshot("n"), "id", "x")) == want
    assert engine.metadata("n")["approx_row_count"] == len(want)
    state = ns_.State(segments=[{"level": x} for x in (2, 1, 1, 1, 1)])
    assert ns_.plan_compaction(state) == (state.segments, 2) and ns_.plan_compaction(ns_.State()) is None


def test_filters_reach_the_scan_below_a_tail(engine, spark):
    engine.write("n", upsert=spark.range(100).selectExpr("id", "id as x"))
    engine.index("n")
    engine.write("n", upsert=[{"id": 3, "x": 77}])
    df = engine.query("n", {"filters": ["x", "Gt", 50], "aggregate_by": {"n": ["Count"]}})
    assert df.collect()[0].n == 50
    assert "GreaterThan(x,50)" in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_indexes_of_a_namespace(engine):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    data = [{"id": i, "vector": v.tolist(), "t": f"word{i % 7} common fox{i}", "g": i % 2} for i, v in enumerate(x)]
    engine.write("n", upsert=data, schema={"t": {"type": "string", "full_text_search": {"stemming": False}}})
    near, text = {"rank_by": ["vector", "ANN", x[5].tolist()], "limit": 5}, {"rank_by": ["t", "BM25", "word3 common"], "limit": 30}
    exact, scored = [[r.id for r in engine.query("n", q).collect()] for q in (near, text)]
    engine.index("n")
    c = engine.collection("n")
    assert c.index is not None and len(c.index.centroids) == 20 and "t" in c.text
    plan = c.query(near)
    assert "PartitionFilters: [cluster_id" in plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert len({r.id for r in plan.collect()} & set(exact)) >= 4 and engine.recall("n", 5)["avg_recall"] >= 0.8
    assert [r.id for r in c.query(text).collect()] == scored
    assert [r.id for r in engine.query("n", near | {"filters": ["g", "Eq", 1]}).collect()][0] == 5
    engine.write("n", deletes=[5, 3], upsert=[{"id": 900, "vector": (x[5] * 1.01).tolist(), "t": "word3 word3 common", "g": 1}])
    assert engine.query("n", near).collect()[0].id == 900 and 5 not in {r.id for r in engine.query("n", near).collect()}
    assert engine.query("n", text).collect()[0].id == 900 and 3 not in {r.id for r in engine.query("n", text).collect()}
    engine.index("n"), engine.compact("n")
    again = engine.query("n", text).collect()
    plain = engine.collection("n")
    plain.text = {}
    want = plain.query(text).collect()
    assert [(r.id, round(r["$dist"], 9)) for r in again] == [(r.id, round(r["$dist"], 9)) for r in want] and again[0].id == 900
    assert engine.rebuild_fts("n") == ["t"] and engine.query("n", text | {"filters": ["g", "Eq", 1]}).count() > 5
    with pytest.raises(ValueError):
        engine.query("n", {"rank_by": ["vector", "ANN", [1.0]]})
    with pytest.raises(NamespaceError):
        engine.write("n", upsert=[{"id": 1, "vector": [1.0]}])


def test_warm_debug_batches_and_collection(engine):
    got = engine.write_many("n", [{"upsert": [{"id": 1, "x": 1}]}, {"upsert": [{"id": None}]}, {"upsert": [{"id": 2, "x": 2}]}])
    assert [type(r).__name__ for r in got] == ["WriteResult", "NamespaceError", "WriteResult"]
    engine.warm("n")
    assert engine.debug("n")["warm"] and engine.snapshot("n").count() == 2
    engine.write("n", upsert=[{"id": 3, "x": 3}])
    assert not engine.debug("n")["warm"] and engine.snapshot("n").count() == 3
    a, b = engine.multi_query("n", [{"aggregate_by": {"n": ["Count"]}}, {"rank_by": ["id", "asc"]}], "eventual")
    assert a.collect()[0].n in (2, 3) and b.count() in (2, 3)
    assert engine.recall("n") == {"avg_recall": 1.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}
    engine.delete("n")
    assert engine.collect() == [] and engine.collect(0) == ["n"]


def test_streams(spark, engine, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, t string").repartition(4).write.json(str(source))
    stream = spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).json(str(source))
    for _ in range(2):  # the second run finds nothing new
        ingest(engine, "s", stream, str(tmp_path / "c1"), None).awaitTermination()
        assert engine.snapshot("s").count() == 50
    index_as_stream(engine, "s", str(tmp_path / "c2")).awaitTermination()
    state = engine.state("s")
    assert state.indexed == state.head > 1 and engine.snapshot("s").count() == 50
    assert json.loads(engine.files.read(engine.path("s", "state", engine.files.names(engine.path("s", "state"))[-1])))["head"] == state.head
