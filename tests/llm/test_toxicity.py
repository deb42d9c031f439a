import random
import re

import numpy as np

from quern.llm import toxicity as tx
from quern.llm.common import span_hash


def key(word):
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(b, np.array([0]), np.array([len(b)]))[0])


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        bad = d % 8 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["Scumm", "idiott", "trashh"]))
        docs.append((d, " ".join(w)))
        if d % 2 == 0:
            labels.append((d, int(bad)))
    return docs, labels


def test_finds_unlabelled_toxic_documents(spark):
    docs, labels = corpus()
    docs += [(1000, "you idiott and Scumm trashh"), (1001, None), (1002, ""), (1003, "the w1 of w2")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, toxic int")
    lb = spark.createDataFrame(labels + [(3, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(df, tx.induce(df, lb)).collect()}
    assert len(got) == len(docs)
    assert all(got[d].toxic == (d % 8 == 0) for d in range(400))
    assert got[1000].toxic and not any(got[d].toxic for d in (1001, 1002, 1003))
    none = tx.toxicity(df, tx.induce(df, lb.where("toxic = 0"))).where("toxic or toxicity > 0").count()
    assert none == 0 and tx.toxicity(df, tx.induce(df, lb.limit(0))).count() == len(docs)


def test_cooccurrence_equals_brute_force(spark):
    docs, _ = corpus(4, 60)
    terms = ["the", "w1", "w2", "w3", "idiott"]
    got = tx.cooccurrence(spark.createDataFrame(docs, "doc_id long, text string"), np.array([key(t) for t in terms], np.uint64))
    want = {}
    for _, t in docs:
        w = re.findall(r"\w+", t.lower())
        at = [(i, terms.index(x)) for i, x in enumerate(w) if x in terms]
        for i, (p, a) in enumerate(at):
            for q, b in at[i + 1 :]:
                if q - p <= tx.WINDOW:
                    k = (min(a, b), max(a, b))
                    want[k] = want.get(k, 0) + 1
    assert {(a, b): c for a, b, c in got.tolist()} == want


def test_polarity_follows_the_graph(monkeypatch):
    monkeypatch.setattr(tx, "SHIFT", 0.0)
    edges = np.array([[0, 1, 50], [2, 3, 50], [1, 2, 1]])
    p = tx.polarity(edges, np.array([1, 0, 0, 0], bool), np.array([0, 0, 0, 1], bool))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < -0.9 and p[3] < -0.9


def test_induces_toxic_words_that_no_label_has(spark):
    docs, labels = corpus(n=800)
    rng = random.Random(2)
    labelled = {d for d, _ in labels}
    for i in range(40):
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        for new in ["idiott", "Scumm", "vermm", "vermm"]:
            w.insert(rng.randrange(len(w)), new)
        docs.append((2000 + i, " ".join(w)))
    docs += [(5000 + d, t) for d, t in corpus(3, 2400)[0] if d % 8]  # toxic words are rare, or keeping company tells little
    docs += [(3000, "w1 vermm w2"), (3001, "w1 of w2")]
    assert not any("vermm" in t for d, t in docs if d in labelled)
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.induce(df, lb)
    assert key("vermm") in lexicon.index.keys.tolist() and not any(key(f"w{i}") in lexicon.index.keys.tolist() for i in range(300))
    got = {r.doc_id: r.toxicity for r in tx.toxicity(df, lexicon).collect()}
    assert got[3000] > 0 and got[3001] == 0


def test_company_equals_brute_force(spark):
    docs, _ = corpus(4, 60)
    got = {r.word: (r.docs, r.near) for r in tx.company(spark.createDataFrame(docs + [(99, None), (98, "")], "doc_id long, text string"), np.array([key("idiott"), key("scumm")], np.uint64)).collect()}
    want = {}
    for _, t in docs:
        w = re.findall(r"\w+", t.lower())
        at = [i for i, x in enumerate(w) if x in ("idiott", "scumm")]
        for x in set(w):
            near = any(y == x and any(abs(i - j) <= tx.WINDOW for j in at) for i, y in enumerate(w))
            n, k = want.get(x, (0, 0))
            want[x] = n + 1, k + near
    assert got == {int(np.uint64(key(x)).astype(np.int64)): v for x, v in want.items()}
