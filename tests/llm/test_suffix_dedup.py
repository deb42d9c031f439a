import random
import re

import numpy as np
import pytest

from quern.llm import suffix_dedup as sd


def _naive(t):
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return sa, lcp


@pytest.mark.parametrize("held, in_memory", [(3, 1 << 20), (1 << 17, 1 << 20), (3, 4)])  # at last all arrays in pages
def test_suffix_array_equals_sorting(tmp_path, held, in_memory):
    rng = random.Random(9)
    folder = f"file://{tmp_path}"
    for _ in range(150 if in_memory > 4 else 60):
        k = rng.choice([1, 2, 3, 20])
        t = [rng.randrange(1, k + 1) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.4:
            t = (t * 3)[:90]
        t.append(0)
        sa, up = sd.suffix_array(np.array(t), folder, held, in_memory, lambda: sd.Paged(folder, 4, 2))
        sa, up = [sa[i] for i in range(len(sa))], [up[i] for i in range(len(up))]
        assert (sa[::-1], [0, *up[:0:-1]]) == _naive(t)


def test_a_sort_far_above_its_memory(tmp_path):
    """20,000 words with two pages of 64 integers an array and 200 tuples a queue."""
    rng = np.random.default_rng(1)
    folder, made = f"file://{tmp_path}", []
    parts = [rng.integers(0, 300, 5000).astype(np.uint64) for _ in range(4)]
    parts[2][100:180] = parts[0][4000:4080]
    parts[3][:60] = parts[3][2000:2060]

    def new():
        made.append(sd.Paged(folder, 64, 2))
        return made[-1]

    got = sd.repeated(parts, folder, 50, 200, 1000, new)
    assert [sorted(x) for x in got] == [[(4000, 4080)], [], [(100, 180)], [(0, 60), (2000, 2060)]]
    assert len(made) > 10 and all(len(x.pages) <= 2 for x in made) and not any(tmp_path.iterdir())


def test_pages_keep_what_was_written(tmp_path):
    rng, a, want = random.Random(4), sd.Paged(f"file://{tmp_path}", 8, 2), []
    for _ in range(3000):
        if want and rng.random() < 0.5:
            i = rng.randrange(len(want))
            if rng.random() < 0.5:
                a[i] = want[i] = rng.randrange(-(1 << 60), 1 << 60)
            assert a[i] == want[i]
        else:
            want.append(rng.randrange(1 << 60))
            a.append(want[-1])
    assert len(a) == len(want) and [a[i] for i in range(len(a))] == want


def test_queue_spills_in_order(tmp_path):
    rng = random.Random(2)
    q, want, got = sd.DiskQueue(f"file://{tmp_path}", 10), [], []
    for _ in range(2000):
        if want and rng.random() < 0.4:
            want.sort()
            assert q.peek() == want[0]
            assert q.pop() == want.pop(0)
        else:
            x = (rng.randrange(50), rng.randrange(50))
            q.push(x)
            want.append(x)
    assert q.spilled > 5 and [q.pop() for _ in want] == sorted(want) and q.peek() is None


def brute(docs, least):
    word = {d: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for d, t in docs if d is not None}
    seen = {}
    for d, w in word.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i))
    cover = {d: set() for d in word}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d] |= set(range(i, i + least))
    out = set()
    for d, c in cover.items():
        for i in c:
            if i - 1 not in c:
                j = i
                while j in c:
                    j += 1
                out.add((d, i, j))
    return out


@pytest.mark.parametrize("seed, least, gram, shard, held, hot", [(1, 10, 6, 50, 1 << 17, 1 << 12), (2, 10, 10, 10**6, 7, 1), (3, 20, 8, 200, 64, 1 << 12), (4, 10, 6, 50, 1 << 17, 3), (5, 12, 7, 300, 64, 1)])
def test_passages_equal_brute_force(spark, seed, least, gram, shard, held, hot):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of"]) if rng.random() < 0.3 else f"é{rng.randrange(60)}"
    shared = [[word() for _ in range(rng.randrange(5, 50))] for _ in range(8)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [word() for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                w += p[a : a + rng.randrange(60)]
        docs.append((d, " ".join(w)))
    docs += [(100, docs[3][1].upper()), (101, " ".join(["ab"] * 70)), (102, None), (103, ""), (104, " ".join(["x", "y"] * 30)), (None, docs[5][1])]
    rows = [*docs, docs[4], docs[4]]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start_word int")
    got = [tuple(r) for r in sd.passages(df, least, gram, shard, held, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, least)
    assert sd.passages(df.limit(0)).count() == 0


def test_a_passage_shared_by_all(spark):
    """One family that holds every document: dealt by anchors, and hot anchors by hashed windows."""
    rng = random.Random(8)
    licence = [f"l{rng.randrange(90)}" for _ in range(60)]
    docs = [(d, " ".join([f"a{rng.randrange(9999)}" for _ in range(rng.randrange(30))] + licence + [f"b{rng.randrange(9999)}" for _ in range(rng.randrange(30))])) for d in range(120)]
    docs += [(500, " ".join(licence)), (501, " ".join(licence[5:]))]
    want = brute(docs, 20)
    for hot in (1 << 12, 50):
        got = {tuple(r) for r in sd.passages(spark.createDataFrame(docs, "doc_id long, text string"), 20, 8, 500, 64, hot).collect()}
        assert got == want


def test_overlapping_surroundings_are_one_place(spark):
    """Anchors of one text that meet in a shard do not repeat each other; a run of one word has an anchor at every word."""
    rng = random.Random(5)
    licence = [f"l{rng.randrange(90)}" for _ in range(40)]
    docs = [(d, " ".join([f"a{d}x{i}" for i in range(9)] + ["hash"] * rng.randrange(40, 90) + [f"b{d}x{i}" for i in range(9)] + licence[: rng.randrange(25, 40)])) for d in range(40)]
    want = brute(docs, 20)
    for hot in (1 << 12, 50):
        got = {tuple(r) for r in sd.passages(spark.createDataFrame(docs, "doc_id long, text string"), 20, 8, 2000, 1 << 17, hot).collect()}
        assert got == want
