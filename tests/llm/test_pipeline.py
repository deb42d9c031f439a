import random

import corpus_pipeline as cp
import numpy as np
from quern.llm.common import lean
from quern.llm.groups import components
from test_ngram_join import MISSED, corpus, small_pair
from test_ngram_join import brute as near


def test_workers_give_freed_memory_back():
    def anon():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

    def run(batches):
        held = [np.ones(8000) for _ in range(2500)]  # 160 MB in pieces of the heap, the last of which stays
        kept.append(held[-1])
        yield from batches
        seen.append(anon())

    kept, seen = [], []
    assert list(lean(run)(iter([1, 2]))) == [1, 2] and anon() < seen[0] - 100


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3), (7, 8), (7, 8)]
    root = {x: x for p in pairs for x in p if None not in p}
    for _ in root:
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _kept_one_of_each(before, after, pairs):
    root = {d: d for d in before}
    for _ in range(len(before)):
        changed = False
        for a, b, _j in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    assert sorted(after) == sorted(set(root.values()))


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    one = cp.quality(spark, docs, sf_dir)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == cols and sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)
    two = cp.near_duplicates(spark, one, sf_dir)
    left = [r.doc_id for r in two.collect()]
    assert two.columns == cols
    _kept_one_of_each(kept, left, near([(d, text[d]) for d in kept], 0.6, 2))
    three = cp.decontaminate(spark, two, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in three.collect()}
    exact = {d for d in left for _, x in items if x in text[d]}
    assert three.columns == cols and not exact & clean and len(clean) >= len(left) - len(exact) - 1
    four = cp.personal_data(spark, three, sf_dir)
    assert four.columns == cols and {r.doc_id for r in four.collect()} == clean
    assert not four.where("text like '%@mail%.example.com%' or text rlike 'password=[0-9a-f]{6}'").count()
    five = {r.doc_id: r for r in cp.tokens(spark, four, sf_dir).collect()}
    assert {d: r.decoded for d, r in five.items()} == {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == clean


def test_repeated_and_null_rows(spark, sf_dir):
    rows = [(1, "the cat sat on the mat today", "en", "s", 3), (1, "the cat sat on the mat today", "en", "s", 3), (2, "the cat sat on the mat today", "en", "s", 3), (None, "the cat sat on the mat today", "en", "s", 3), (3, None, None, None, None), (4, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in cp.near_duplicates(spark, df, sf_dir).collect())
    assert got == [-1, 1, 3, 4]
    for stage in (cp.decontaminate, cp.personal_data):
        assert stage(spark, df, sf_dir).count() == 6
    assert cp.near_duplicates(spark, df.limit(0), sf_dir).count() == 0


def test_near_duplicates_loses_no_link(spark, sf_dir):
    docs = list(enumerate(s for seed in MISSED for s in small_pair(seed)))
    df = spark.createDataFrame([(d, s, "en", "s", len(s)) for d, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r.doc_id for r in cp.near_duplicates(spark, df, sf_dir).collect()]
    assert sorted(left) == [d for d, _ in docs if d % 2 == 0]
    _kept_one_of_each([d for d, _ in docs], left, near(docs, 0.6, 2))


def test_every_text_of_a_repeated_id_is_compared(spark, sf_dir):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " end"), (3, text("b") + " end")]  # 1 stays with both texts, 2 and 3 go
    rows += [(5, text("c")), (5, text("d")), (4, text("c") + " end"), (6, text("d").upper())]  # of 5 only the text that 4 has goes
    rows += [(7, text("e")), (7, text("e")), (7, text("e").upper()), (7, text("e") + " end"), (8, text("f")), (8, None), (8, None), (None, text("a")), (None, None)]
    rows += [(100 + d % 40, s) for d, s in corpus(13, 120)]
    df = spark.createDataFrame([(d, s, "en", "s", 0) for d, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_duplicates(spark, df, sf_dir)
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and sorted(t for d, t in left if d is None and t) == [text("a")]
    docs = sorted({(d, s) for d, s in rows if d is not None and s is not None})
    groups = [{k} for k in range(len(docs))]
    for a, b, _ in near(list(enumerate(s for _, s in docs)), 0.6, 2):
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for k in groups[b]:
                groups[k] = groups[a]
    assert sorted((d, s) for d, s in left if d is not None and d < 7) == [(1, text("a")), (1, text("b")), (4, text("c") + " end"), (5, text("d"))]
    assert sum(d == 7 for d, _ in left) == 1 and sorted((d, s or "") for d, s in left if d == 8) == [(8, ""), (8, text("f"))]
    at = {doc: min(groups[k]) for k, doc in enumerate(docs)}
    kept = [(at[r], r[0]) for r in left if r in at]
    assert sorted(kept) == sorted({(k, docs[k][0]) for k in at.values()})  # one of each group, of its least id


def test_run_saves_every_stage_but_the_last(spark, sf_dir, monkeypatch):
    tags, real = [], cp.saved
    monkeypatch.setattr(cp, "saved", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    monkeypatch.setattr(cp, "STAGES", [(name, lambda s, d, _: d) for name, _ in cp.STAGES])
    assert cp.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert tags == ["stage"] * (len(cp.STAGES) - 1)
