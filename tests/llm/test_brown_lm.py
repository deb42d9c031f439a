import math
import random
import re
from collections import Counter

import numpy as np

from quern.llm import brown_lm as lm


def corpus(seed, n=60):
    rng = random.Random(seed)
    noun, verb = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    return [(d, " ".join(f"the {rng.choice(noun)} {rng.choice(verb)}" for _ in range(rng.randrange(1, 12)))) for d in range(n)]


def tokens(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def test_counts_cover_the_corpus(spark):
    docs = corpus(1) + [(99, None), (98, ""), (1, "the N1!")]
    got = sorted(r.times for r in lm.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(Counter(w for _, t in docs for w in tokens(t)).values())


def test_exchange_raises_likelihood_exactly():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 9, (14, 14)) * rng.integers(0, 2, (14, 14))
    start = np.append(np.arange(12) % 3, [3, 4])
    of = lm.exchange(table, 12, 3, 50)
    best = lm.likelihood(table, of)
    assert best >= lm.likelihood(table, start)
    for w in range(12):  # no single move is better: the sweep's gains are the true ones
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert lm.likelihood(table, other) <= best + 1e-6


def test_classes_follow_word_roles(spark):
    df = spark.createDataFrame(corpus(2, 200), "doc_id long, text string")
    model = lm.fit(df, exchange_words=25, classes=3)
    words = sorted({w for _, t in corpus(2, 200) for w in tokens(t)})
    import quern.llm.common as c

    at = {}
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        at[w] = int(model.of[model.units.of(c.span_hash(b, np.array([0]), np.array([len(b)])))[0]])
    assert len({at[w] for w in words if w[0] == "n" and w != "n"}) == 1 and len({at[w] for w in words if w[0] == "v"}) == 1
    assert len({at["the"], at["n1"], at["v1"]}) == 3


def test_scores_equal_brute_force(spark):
    docs = corpus(5, 80) + [(500, "rare1 the n1"), (501, None), (502, "!!"), (503, "zzz rare1 v3"), (503, "zzz rare1 v3")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, bits int")
    model = lm.fit(df, exchange_words=10, classes=3)
    u = model.units
    import quern.llm.common as c

    def unit(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return int(u.of(c.span_hash(b, np.array([0]), np.array([len(b)])))[0])

    count = Counter(w for _, t in docs for w in tokens(t))
    assert u.types.sum() == len(count) - u.words
    got = {r.doc_id: r for r in lm.perplexity(df, model).collect()}
    pairs, left, classes = Counter(), Counter(), Counter()
    for _, t in docs:
        prev = model.of[u.start]
        for w in tokens(t):
            k = model.of[unit(w)]
            pairs[prev, k] += 1
            left[prev] += 1
            classes[k] += 1
            prev = k
    kinds = [k for k in range(int(model.of.max()) + 1) if k != model.of[u.start]]
    total = sum(classes[k] + 1 for k in kinds)
    for d, t in docs:
        bits, prev = 0.0, model.of[u.start]
        for w in tokens(t):
            i = unit(w)
            k = model.of[i]
            step = (pairs[prev, k] + lm.DISCOUNT * (classes[k] + 1) / total) / (left[prev] + lm.DISCOUNT)
            emit = count[w] / classes[k] if i < u.words else 1 / (u.types[i - u.words] + 1)
            bits -= math.log2(step * emit)
            prev = k
        assert got[d].n_words == len(tokens(t)) and abs(got[d].bits - bits) < 1e-3 * max(1, len(tokens(t)))
        assert (got[d].perplexity is None) == (not tokens(t))
    assert lm.perplexity(df.limit(0), lm.fit(df.limit(0))).count() == 0


def test_every_word_counts_whatever_is_sent_to_executors(spark):
    docs = corpus(5, 80) + [(500, "rare1 the n1"), (501, None), (502, "!!"), (503, "zzz rare1 v3"), (503, "zzz rare1 v3"), (None, "n1"), (504, "v1 v1 q q q the")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id, r.bits)
    rows = [sorted(lm.perplexity(df, m, m.fitted).collect(), key=key) for m in (lm.fit(df, 4, 3), lm.fit(df, 4, 3, 7), lm.fit(df, 4, 3, 0))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(docs)
    model = lm.fit(df, 4, 3, 7)
    assert sorted(lm.perplexity(df, model).collect(), key=key) == rows[0]
    left, sent = Counter({r.word: r.times for r in model.rest.collect()}), model.units.words
    count = Counter(w for _, t in docs for w in tokens(t))
    assert sent == 7 and sorted(left.values()) == sorted(count.values())[: len(count) - 4]
    one = lm.perplexity(spark.createDataFrame([(1, "never seen")], "doc_id long, text string"), model).first()
    assert one.n_words == 2 and one.perplexity > 1


def test_rare_words_join_the_class_of_their_neighbours(spark):
    rng = random.Random(9)
    docs = [(d, " ".join(f"the {rng.choice(['n1', 'n2', 'n3'])} {rng.choice(['v1', 'v2', 'v3'])}" for _ in range(9))) for d in range(60)]
    docs += [(100 + i, f"the noun{i} v1 the n2 verb{i} the") for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.fit(df, 7, 3)
    import quern.llm.common as c

    def of(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return int(model.of[model.units.of(c.span_hash(b, np.array([0]), np.array([len(b)])))[0]])

    assert {of(f"noun{i}") for i in range(8)} == {of("n1")} and {of(f"verb{i}") for i in range(8)} == {of("v1")} and of("n1") != of("v1")


def test_rare_words_travel_packed_and_are_written_in_few_files(spark, monkeypatch):
    docs = corpus(5, 80) + [(500 + i, f"the rare{i} v1 rare{i % 7}") for i in range(40)] + [(600, None), (601, ""), (602, "rare1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(lm.fit(df, 4, 3, 7).rest.collect())
    monkeypatch.setattr(lm, "PART_TOKENS", 32)
    rest = lm.fit(df, 4, 3, 7).rest
    assert sorted(rest.collect()) == want and len(rest.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))

    top = [w for w, _ in Counter(w for _, t in docs for w in tokens(t)).most_common(4)]
    import quern.llm.common as c

    key = lambda w: int(c.span_hash(b := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(b)]))[0])
    of, parts = np.array([0, 1, 2, 0, 3, 4]), 6
    class_of = lambda w: int(of[top.index(w)]) if w in top else 3
    near = Counter()
    for _, t in docs:
        ws = tokens(t)
        for i, w in enumerate(ws):
            if w not in top:
                near[key(w), class_of(ws[i - 1]) if i else 4] += 1
                if i + 1 < len(ws):
                    near[key(w), 5 + class_of(ws[i + 1])] += 1
    got, rows = Counter(), lm._neighbours(df.coalesce(1), lm.Units(np.array([key(w) for w in top], np.uint64), 1), of, parts).collect()
    for r in rows:
        for h, code, n in zip(np.frombuffer(r.word, np.uint64), np.frombuffer(r.code, np.int16), np.frombuffer(r.times, np.int64)):
            assert int(h) * parts >> 64 == r.part
            got[int(h), int(code)] += int(n)
    assert got == near and len(rows) <= parts
