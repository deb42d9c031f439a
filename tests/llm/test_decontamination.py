import random

import numpy as np

from quern.llm import decontamination as dc


def _distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance to any stretch, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != t))
    return min(row)


def test_myers_equals_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, n))) for n in (12, 40))
        assert dc.myers(a, b) == (_distance(a, b) if a else 0)


def test_normalise():
    raw = [t.encode() for t in ["", "a", "  the  cat!!sat ", "é;è"]]
    out, off = dc.normalise(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [out[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == [" ", " a ", " the cat sat ", " é è "]


def _brute(docs, items, rate):
    out = set()
    for d, t in docs:
        for i, x in items:
            if t is None or x is None:
                continue
            core = dc.normalise_text(x).strip(b" ")
            if not core:
                continue
            k = int(rate * len(core))
            body = core if k else b" " + core + b" "
            best = _distance(body, dc.normalise_text(t))
            if best <= k:
                out.add((d, i, best))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 6, 20, 40])))) for i in range(12)] + [(90, None), (91, ""), (92, " !! "), (93, "ab")]
    docs = []
    for d in range(40):
        t = [word() for _ in range(rng.randrange(0, 60))]
        for _, x in rng.sample(items[:12], 2):
            s = list(x.upper() if rng.random() < 0.3 else x)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(s))
                s[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "qq"])
            t.insert(rng.randrange(len(t) + 1), "".join(s))
        docs.append((d, ", ".join(t) if rng.random() < 0.5 else " ".join(t)))
    docs += [(98, None), (99, ""), (1, docs[1][1])]
    a = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for rate in (0.05, 0.15):
        for limit in (1 << 20, 200):
            got = dc.contaminated(a, b, rate, limit).collect()
            assert len(got) == len(set(got))
            assert {tuple(r) for r in got} == _brute(docs, items, rate)
    assert dc.contaminated(a.limit(0), b).count() == 0 and dc.contaminated(a, b.limit(0)).count() == 0
    left = {r.doc_id for r in dc.clean(a, b).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in _brute(docs, items, dc.ERROR_RATE)}
