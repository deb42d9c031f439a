"""Repeated passages by suffix sorting with external induced sorting.

A passage of at least MIN_WORDS words is repeated if it stands at two places of
the corpus, in two documents or in one.  The result marks, for every document,
the stretches of words covered by repeated passages.

The corpus is first thinned without loss.  Of every MIN_WORDS - GRAM + 1
consecutive GRAM-word hashes the least is an anchor, so equal passages of
MIN_WORDS words have an equal anchor at an equal place; text without an anchor
that occurs twice holds no repeat.  What is left are regions of documents;
regions that share anchors, directly or through others, form families
(connected components), and whole families are dealt to shards, so every repeat
lies inside one shard.  Equal texts enter once, as do equal regions of a shard.

A family of more than SHARD_WORDS words is not dealt as a whole: a repeated
window of MIN_WORDS words lies around an anchor that its copies have, too, so the
surroundings of the family's anchors are dealt by anchor (those of one text that
overlap in a shard are joined, as they are one place) and what each shard
covers is united.  Anchors of more than HOT_ANCHOR places are no work for one
shard either: of their places all windows of MIN_WORDS words are hashed, and
those of equal hash are repeats.

A shard's regions, as ranks of words with separators between, are suffix-sorted
by induction.  The left-most S suffixes are ordered by sorting their substrings
in a disk-backed queue, naming them and recurring on the names; then L suffixes
and after them S suffixes are induced through disk-backed priority queues whose
tuples carry the first word, the time of the source, the place, and the length
of the prefix shared with the tuple before.  That length is one more than the
least common prefix among the sources processed in between, which a monotone
stack of the values so far answers.  Tuples beyond HELD go to sorted runs in the
cluster's shared folder.  The text and the arrays of the sort are lists for up to
IN_MEMORY words and pages in the shared folder beyond (`Paged`: only some pages
are held), so a shard may exceed the memory; what stays there is an entry a
distinct word and the stack.  Suffixes with a neighbour of common prefix MIN_WORDS
or more are repeats.

Words are lower-cased runs of letters and digits (bytes >= 0x80 included); spans
count words from 0, half open.

Defined cases: null ids and null or wordless texts have no spans; of rows that
repeat an id with equal text one counts; equal texts of at least MIN_WORDS words
repeat each other whole; long texts are sorted whole; only doc_id and text are
read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import join_groups, mix, powers, root, saved, texts, words
from .groups import components

MIN_WORDS, GRAM = 50, 32
#: Words of a shard, aimed at; tuples of a queue kept in memory; tuples of a block of a run; ids up to which a table is broadcast.
SHARD_WORDS, HELD, BLOCK, BROADCAST_ROWS = 1 << 18, 1 << 16, 1 << 12, 1 << 18
#: Words of a sort whose arrays are lists; integers of a page and pages of an array held beyond; places of an anchor that one shard takes.
IN_MEMORY, PAGE, HELD_PAGES, HOT_ANCHOR = 1 << 21, 1 << 13, 64, 1 << 12


def _system(folder: str):
    """(file system, path) of a qualified folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class Paged:
    """Growing array of integers in pages on disk, of which `held` stay in memory."""

    def __init__(self, folder: str, page: int = PAGE, held: int = HELD_PAGES):
        self.system, path = _system(folder)
        self.path, self.page, self.held, self.size = f"{path}/{uuid.uuid4().hex}", page, held, 0
        self.system.create_dir(self.path, recursive=True)
        self.pages: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def _get(self, p: int) -> np.ndarray:
        page = self.pages.pop(p, None)
        if page is None:
            if p * self.page >= self.size:
                page = np.zeros(self.page, np.int64)
            else:
                with self.system.open_input_stream(f"{self.path}/{p}") as f:
                    page = np.frombuffer(f.read(), np.int64).copy()
            if len(self.pages) >= self.held:  # the page not used for longest goes
                old, data = next(iter(self.pages.items()))
                del self.pages[old]
                if old in self.changed:
                    self.changed.discard(old)
                    with self.system.open_output_stream(f"{self.path}/{old}") as f:
                        f.write(data.tobytes())
        self.pages[p] = page
        return page

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if i >= self.size:
            raise IndexError(i)
        return int(self._get(i // self.page)[i % self.page])

    def __setitem__(self, i: int, v: int) -> None:
        p = i // self.page
        self._get(p)[i % self.page] = v
        self.changed.add(p)

    def append(self, v: int) -> None:
        self[self.size] = v
        self.size += 1

    def close(self) -> None:
        self.system.delete_dir(self.path)


class DiskQueue:
    """Priority queue of tuples; beyond `held` tuples the present ones become a sorted run in `folder` (any file system)."""

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held = folder, held
        self.heap: list = []
        self.fronts: list = []
        self.runs: dict[int, tuple] = {}
        self.spilled = 0

    def push(self, item) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.spill()

    def spill(self) -> None:
        system, path = _system(self.folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}"
        self.heap.sort()
        with system.open_output_stream(name) as out:
            for i in range(0, len(self.heap), BLOCK):
                raw = pickle.dumps(self.heap[i : i + BLOCK], 5)
                out.write(len(raw).to_bytes(8, "little"))
                out.write(raw)
        self.heap = []
        run = self.spilled = self.spilled + 1
        self.runs[run] = (system, name, system.open_input_stream(name))
        self._next(run)

    def _next(self, run: int) -> None:
        system, name, file = self.runs[run]
        size = file.read(8)
        if size:
            block = pickle.loads(file.read(int.from_bytes(size, "little")))
            heapq.heappush(self.fronts, (block[0], run, 0, block))
        else:
            file.close()
            system.delete_file(name)
            del self.runs[run]

    def peek(self):
        """The least tuple, or None."""
        if self.fronts and (not self.heap or self.fronts[0][0] <= self.heap[0]):
            return self.fronts[0][0]
        return self.heap[0] if self.heap else None

    def pop(self):
        if self.fronts and (not self.heap or self.fronts[0][0] <= self.heap[0]):
            item, run, i, block = self.fronts[0]
            if i + 1 < len(block):
                heapq.heapreplace(self.fronts, (block[i + 1], run, i + 1, block))
            else:
                heapq.heappop(self.fronts)
                self._next(run)
            return item
        return heapq.heappop(self.heap)


def _profile(t, typed, run, lms) -> None:
    """For each place: 2 x value + whether an S suffix starts there, and the length of the run of equal values; left-most S places.  All from the last to the first, in blocks."""
    n = len(t)
    after, length, kind = -1, 0, True  # the value, run and type behind the block
    for b in range(n, 0, -BLOCK):
        a = max(b - BLOCK, 0)
        v = np.fromiter((t[i] for i in range(a, b)), np.int64, b - a) if not isinstance(t, np.ndarray) else t[a:b].astype(np.int64)
        end = np.flatnonzero(np.append(v[1:] != v[:-1], True))
        end = end[np.searchsorted(end, np.arange(b - a))]
        size = end - np.arange(b - a) + 1
        last = end == b - a - 1
        s = np.where(last, after > v, v[np.minimum(end + 1, b - a - 1)] > v)
        if after == v[-1]:
            size = size + np.where(last, length, 0)
            s = np.where(last, kind, s)
        if b == n:
            s = np.where(last, True, s)
        if b < n and kind and not s[-1]:
            lms.append(b)
        for i in np.flatnonzero(s[1:] & ~s[:-1])[::-1] + a + 1:
            lms.append(int(i))
        for x, y in zip((2 * v + s)[::-1].tolist(), size[::-1].tolist()):
            typed.append(x)
            run.append(y)
        after, length, kind = int(v[0]), int(size[0]), bool(s[0])


class _Backwards:
    """A sequence filled from the last element to the first, read from the first."""

    def __init__(self, inner):
        self.inner, self.top = inner, len(inner) - 1

    def __getitem__(self, i: int) -> int:
        return self.inner[self.top - i]

    def __len__(self) -> int:
        return self.top + 1


def suffix_array(t, folder: str, held: int = HELD, in_memory: int = IN_MEMORY, new=None):
    """(suffixes of t in descending order, the common prefix of each with the next greater one); t ends with its only least value.

    Both are lists, or `Paged` where t has more than in_memory values.
    """
    n = len(t)
    if n == 1:
        return [0], [0]
    paged = n > in_memory
    new = new or (lambda: Paged(folder))
    used: list[Paged] = []

    def array():
        if not paged:
            return []
        used.append(new())
        return used[-1]

    if paged:
        parts = array(), array(), array()
        _profile(t, *parts)
        typed, run, starts = (_Backwards(x) for x in parts)
        text_at, cut = (lambda i: typed[i] >> 1), (lambda a, b: tuple(typed[i] for i in range(a, b + 1)))
    else:
        t = np.asarray(t, np.int64)
        change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
        end = change[np.searchsorted(change, np.arange(n))]  # last of the run of equal values
        run = (end - np.arange(n) + 1).tolist()
        s_type = np.where(end + 1 < n, t[np.minimum(end + 1, n - 1)] > t, True)
        starts = np.flatnonzero(s_type & np.append(False, ~s_type[:-1])).tolist()
        text = t.tolist()
        typed = (2 * t + s_type).tolist()  # of equal values, one that starts an L suffix comes before one that starts an S suffix
        text_at, cut = text.__getitem__, lambda a, b: tuple(typed[a : b + 1])
    m = len(starts)

    # order of the left-most S suffixes, and common prefixes of neighbours among them
    queue = DiskQueue(folder, held)
    for j in range(m):
        queue.push((cut(starts[j], starts[j + 1] if j + 1 < m else n - 1), j))
    named = DiskQueue(folder, held)
    before, name = None, -1
    for _ in range(m):
        part, j = queue.pop()
        if part != before:
            name += 1
            before = part
        named.push((j, name))
    names, order, common = array(), array(), array()
    for _ in range(m):
        names.append(named.pop()[1])
    if name + 1 < m:
        down, up = suffix_array(names if paged else np.array(names, np.int64), folder, held, in_memory, new)
        for r in range(m - 1, -1, -1):
            order.append(down[r])
            common.append(up[r + 1] if r + 1 < m else 0)
        for x in (down, up):
            if isinstance(x, Paged):
                x.close()
    else:
        by_name = DiskQueue(folder, held)
        for j in range(m):
            by_name.push((names[j], j))
        for _ in range(m):
            order.append(by_name.pop()[1])
            common.append(0)
    lcp_lms = array()
    for r in range(m):
        if not r:
            lcp_lms.append(0)
            continue
        x, y, k = order[r - 1], order[r], common[r]
        a, b = starts[x + k] if x + k < m else n, starts[y + k] if y + k < m else n
        length = b - starts[y]
        while a < n and b < n and text_at(a) == text_at(b):
            a, b, length = a + 1, b + 1, length + 1
        lcp_lms.append(length)

    # L suffixes, ascending
    queue, last = DiskQueue(folder, held), {}
    l_pos, l_lcp = array(), array()
    add_pos, add_lcp, fronts, heap = l_pos.append, l_lcp.append, queue.fronts, queue.heap
    at, low = [], []  # times and values whose least none after them undercuts: that since a time is the first behind it
    r, time, prev_first, prev_run, prev_lms = 0, 0, -1, 0, False
    i = starts[order[0]] if m else 0
    wait = typed[i] >> 1 if m else n + 1  # first value of the next left-most S suffix
    while True:
        if fronts:
            top = queue.peek()
        else:
            top = heap[0] if heap else None
        if top is not None and (r >= m or top[0] <= wait):
            first, _, j, lcp = queue.pop() if fronts else heappop(heap)
            add_pos(j)
            add_lcp(lcp)
            prev_lms = False
            prev_run = run[j]
        elif r < m:
            j, first = i, wait
            size = run[j]
            lcp = 0 if first != prev_first else lcp_lms[r] if prev_lms else min(prev_run, size)
            r += 1
            if r < m:
                i = starts[order[r]]
                wait = typed[i] >> 1
            prev_lms = True
            prev_run = size
        else:
            break
        prev_first = first
        while low and low[-1] >= lcp:
            at.pop()
            low.pop()
        at.append(time)
        low.append(lcp)
        if j:
            c = typed[j - 1]
            if not c & 1:
                c >>= 1
                heappush(heap, (c, time, j - 1, 1 + low[bisect_right(at, last[c])] if c in last else 0))
                last[c] = time
                if len(heap) > held:
                    queue.spill()
                    heap = queue.heap
        time += 1

    # S suffixes, descending; L suffixes join in from their list
    queue, last = DiskQueue(folder, held), {}
    sa, lcps = array(), array()
    add_pos, add_lcp, fronts, heap = sa.append, lcps.append, queue.fronts, queue.heap
    at, low = [], []
    r, time, prev_first, prev_run, prev_l = len(l_pos) - 1, 0, -1, 0, -1
    i = l_pos[r] if r >= 0 else 0
    wait = typed[i] >> 1 if r >= 0 else -1
    while True:
        if fronts:
            top = queue.peek()
        else:
            top = heap[0] if heap else None
        if top is not None and (r < 0 or -top[0] >= wait):
            first, _, j, lcp = queue.pop() if fronts else heappop(heap)
            first = -first
            prev_l = -1
            prev_run = run[j]
        elif r >= 0:
            j, first = i, wait
            size = run[j]
            lcp = 0 if first != prev_first else l_lcp[prev_l] if prev_l >= 0 else min(prev_run, size)
            prev_l = r
            r -= 1
            if r >= 0:
                i = l_pos[r]
                wait = typed[i] >> 1
            prev_run = size
        else:
            break
        prev_first = first
        add_pos(j)
        add_lcp(lcp)
        while low and low[-1] >= lcp:
            at.pop()
            low.pop()
        at.append(time)
        low.append(lcp)
        if j:
            c = typed[j - 1]
            if c & 1:
                c >>= 1
                heappush(heap, (-c, time, j - 1, 1 + low[bisect_right(at, last[c])] if c in last else 0))
                last[c] = time
                if len(heap) > held:
                    queue.spill()
                    heap = queue.heap
        time += 1
    sa.append(n - 1)
    lcps.append(0)
    for x in used:
        if x is not sa and x is not lcps:
            x.close()
    return sa, lcps


def repeated(parts: list[np.ndarray], folder: str, least: int = MIN_WORDS, held: int = HELD, in_memory: int = IN_MEMORY, new=None) -> list[list[tuple[int, int]]]:
    """For each word sequence the stretches covered by sequences of `least` words or more that stand at two places of the parts."""
    kinds: dict[bytes, int] = {}
    which = [kinds.setdefault(p.tobytes(), len(kinds)) for p in parts]
    times = np.bincount(which, minlength=len(kinds))
    once = [np.frombuffer(k, np.uint64) for k in kinds]
    m = len(once)
    _, rank = np.unique(np.concatenate(once), return_inverse=True)
    sizes = np.array([len(p) for p in once])
    ends = np.cumsum(sizes) + np.arange(m)
    first = ends - sizes
    t = np.empty(int(sizes.sum()) + m, np.int64)
    inside = np.ones(len(t), bool)
    inside[ends] = False
    t[inside] = rank + m
    t[ends] = np.append(np.arange(1, m), 0)
    sa, up = suffix_array(t, folder, held, in_memory, new)
    hits, below = DiskQueue(folder, held), 0
    for k in range(len(sa)):  # up[k]: common prefix with sa[k - 1], `below`: with sa[k + 1]
        below = up[k + 1] if k + 1 < len(sa) else 0
        most = max(up[k], below)
        if most >= least:
            hits.push((sa[k], sa[k] + most))
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    start = end = -1

    def put(a: int, b: int) -> None:
        k = int(np.searchsorted(ends, a, "left"))
        found[k].append((a - int(first[k]), b - int(first[k])))

    while hits.peek() is not None:
        a, b = hits.pop()
        if a > end:
            if end > 0:
                put(start, end)
            start, end = a, b
        end = max(end, b)
    if end > 0:
        put(start, end)
    for x in (sa, up):
        if isinstance(x, Paged):
            x.close()
    return [[(0, len(parts[i]))] if times[k] > 1 and len(parts[i]) >= least else found[k] for i, k in enumerate(which)]


def _text_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    pw, ipw = powers(len(h) + 1)
    c = np.append(np.uint64(0), np.cumsum(h * pw[: len(h)]))
    return mix((c[bounds[1:]] - c[bounds[:-1]]) * ipw[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def anchors(h: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each anchor among the words, hash); only texts of at least `least` words have any."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pw, ipw = powers(len(h) + 1)
    c = np.append(np.uint64(0), np.cumsum(h * pw[: len(h)]))
    g = mix((c[gram:] - c[:-gram]) * ipw[:n]) >> np.uint64(1)
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)[:n]
    valid = (np.arange(n) + gram <= end) & np.repeat(size >= least, size)[:n]
    g = np.where(valid, g, np.iinfo(np.uint64).max)
    w = least - gram + 1
    wide = np.append(g, np.full(w - 1, np.iinfo(np.uint64).max, np.uint64))
    picked = np.zeros(n, bool)
    for i in range(0, n, 1 << 16):  # of each window the leftmost least
        view = np.lib.stride_tricks.sliding_window_view(wide[i : min(n, i + (1 << 16)) + w - 1], w)
        inner = np.arange(i, i + len(view)) + least <= np.repeat(bounds[1:], size)[i : i + len(view)]
        at = (view.argmin(1) + np.arange(i, i + len(view)))[inner]
        picked[at] = True
    at = np.flatnonzero(picked & valid)
    return at, g[at]


def passages(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, held: int = HELD, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word) of the stretches of each document that repeated passages cover."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.lower("text").alias("text")).where("doc is not null")

    def mark(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for i, j, buf, off in texts(b.column(1)):
                h, bounds = words(buf, off)
                key, size = _text_keys(h, bounds), np.diff(bounds)
                at, g = anchors(h, bounds, least, gram)
                of = np.searchsorted(bounds, at, "right") - 1
                long = np.flatnonzero(size >= least)  # and one row a text, under the text's own hash
                doc = np.concatenate([of, long])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g, key[long]]).view(np.int64)), pa.array(key[doc].view(np.int64)), pa.array(ids[i:j][doc]), pa.array(np.concatenate([at - bounds[of], -size[long]]).astype(np.int32))],
                    ["anchor", "txt", "doc", "place"],
                )

    def keep(batches):
        parts = [[np.asarray(b.column(c)) for c in range(4)] for b in batches]
        if not parts:
            return
        anchor, txt, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, place, txt, anchor))
        anchor, txt, doc, place = (x[order] for x in (anchor, txt, doc, place))
        head = np.append(True, (anchor[1:] != anchor[:-1]) | (txt[1:] != txt[:-1]) | (place[1:] != place[:-1]))
        new = head | np.append(True, doc[1:] != doc[:-1])
        anchor, txt, doc, place, head = (x[new] for x in (anchor, txt, doc, place, head))
        whole = place < 0
        first = np.flatnonzero(head)
        times = np.repeat(np.diff(np.append(first, len(head))), np.diff(np.append(first, len(head))))
        same = whole & (times > 1)
        at = np.flatnonzero(head & ~whole)
        a = anchor[at]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(np.append(begin, len(a))), np.diff(np.append(begin, len(a)))) > 1
        at = np.concatenate([at[many], np.flatnonzero(same)])
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (anchor, txt, doc, place)], ["anchor", "txt", "doc", "place"])

    rows = "anchor long, txt long, doc long, place int"
    kept = saved(src.mapInArrow(mark, rows).repartition("anchor").mapInArrow(keep, rows), "anchors")
    copies = kept.where("place < 0").select("doc", "txt", (-F.col("place")).alias("size"))

    def join_up(batches):
        """Regions from a partition's rows, sorted by text and place: one row an anchor, with its region."""
        parts = [[np.asarray(b.column(c)) for c in range(4)] for b in batches]
        if not parts:
            return
        anchor, txt, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, txt))
        anchor, txt, doc, place = (x[order] for x in (anchor, txt, doc, place))
        if not len(txt):
            return
        slack = least - gram
        cut = np.append(True, (txt[1:] != txt[:-1]) | (place[1:] - slack >= place[:-1] + least))
        start = np.flatnonzero(cut)
        of = np.cumsum(cut) - 1
        lo = np.maximum(place[start] - slack, 0)
        hi = place[np.append(start[1:], len(place)) - 1] + least
        region = (mix(txt[start].view(np.uint64) ^ mix(lo.astype(np.uint64))) >> np.uint64(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(txt), pa.array(doc), pa.array(region[of]), pa.array(lo[of].astype(np.int32)), pa.array(hi[of].astype(np.int32)), pa.array(place)], ["anchor", "txt", "doc", "region", "lo", "hi", "place"])

    linked = saved(kept.where("place >= 0").repartition("txt").mapInArrow(join_up, "anchor long, txt long, doc long, region long, lo int, hi int, place int"), "linked")
    leader = F.min("region").over(Window.partitionBy("anchor"))
    links = linked.select("anchor", "region").distinct().select("region", leader.alias("leader")).where("region != leader").distinct()
    family = components(links)
    regions = linked.groupBy("region").agg(F.min("txt").alias("txt"), F.min("doc").alias("doc"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    # a text repeated as a whole is covered as a whole: its regions matter to others, not to itself
    regions = regions.join(family.select(F.col("node").alias("region"), "root"), "region", "left").select("region", "doc", "txt", "lo", "hi", F.coalesce("root", "region").alias("family"))
    regions = saved(regions, "regions")
    words_of = F.sum(F.col("hi") - F.col("lo")).alias("words")
    large = saved(regions.groupBy("family").agg(words_of, F.count(F.lit(1)).alias("n")).where(F.col("words") > shard_words), "large")
    total = regions.agg(words_of, F.countDistinct("doc")).first()
    shards = max(1, -(-(total[0] or 0) // shard_words))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    pieces = regions.select("doc", "txt", "lo", "hi", shard("family"))
    if not large.isEmpty():
        several = saved(join_groups(regions, large, ["family"]).select("region"), "several")
        pieces = regions.join(several, "region", "left_anti").select("doc", "txt", "lo", "hi", shard("family"))
        around = linked.join(several, "region", "left_semi").select("anchor", "doc", "txt", F.greatest(F.col("place") - (least - gram), F.lit(0)).alias("lo"), (F.col("place") + least).alias("hi"))
        often = saved(around.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "often")
        around = join_groups(around, often, ["anchor"])
        # many places to a shard, but those of one anchor together; -1: all windows are hashed
        spread = max(shards, -(-(often.agg(F.sum("n")).first()[0] or 0) * (2 * least - gram) // shard_words))
        where = F.when(F.col("n") > hot_anchor, -1).otherwise(shards + F.pmod(F.xxhash64("anchor"), F.lit(spread)))
        pieces = pieces.unionByName(around.select("doc", "txt", "lo", "hi", where.cast("int").alias("shard")).distinct())
    wanted = pieces.groupBy("doc").agg(F.collect_list(F.struct("txt", "lo", "hi", "shard")).alias("r"))  # the places of one document
    wanted = wanted.select("doc", *(F.col(f"r.{c}").alias(c) for c in ("txt", "lo", "hi", "shard")))
    if (total[1] or 0) <= BROADCAST_ROWS and large.isEmpty():
        wanted = F.broadcast(wanted)

    def cut(batches):
        for b in batches:
            ids, cols = b.column(0).to_pylist(), [b.column(c).to_pylist() for c in range(2, 6)]
            for i, j, buf, off in texts(b.column(1)):
                h, bounds = words(buf, off)
                key = _text_keys(h, bounds).view(np.int64)
                out = []
                for k in range(i, j):
                    own = h[bounds[k - i] : bounds[k - i + 1]]
                    out += [(s, ids[k], int(x), lo, own[lo:hi].view(np.int64)) for x, lo, hi, s in zip(*(c[k] for c in cols)) if x == key[k - i]]
                if out:
                    shard, doc, txt, lo, part = zip(*out)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), pa.array(np.concatenate(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(doc, pa.int64()), pa.array(txt, pa.int64()), pa.array(lo, pa.int32()), lists], ["shard", "doc", "txt", "lo", "words"])

    parts = src.join(wanted, "doc").select("doc", "text", "txt", "lo", "hi", "shard").mapInArrow(cut, "shard int, doc long, txt long, lo int, words array<long>")
    if not large.isEmpty():
        parts = saved(parts, "parts")

    def sort(table):
        seen = {}
        for doc, txt, lo, own in zip(table["doc"].to_pylist(), table["txt"].to_pylist(), table["lo"].to_pylist(), table["words"]):
            own = np.asarray(own.values).view(np.uint64)
            if (txt, lo) not in seen or len(own) > len(seen[txt, lo][1]):  # several anchors near a text's start have surroundings from 0
                seen[txt, lo] = (doc, own)
        places: list[tuple[int, int, int, list[np.ndarray], int]] = []  # (doc, text, first word, parts, end): surroundings that overlap are one place
        for txt, lo in sorted(seen):
            doc, own = seen[txt, lo]
            if places and places[-1][1] == txt and lo < places[-1][4]:
                doc, _, start, parts, end = places[-1]
                if lo + len(own) > end:
                    parts.append(own[end - lo :])
                    places[-1] = (doc, txt, start, parts, lo + len(own))
            else:
                places.append((doc, txt, lo, [own], lo + len(own)))
        own_folder = f"{folder}/suffixes-{uuid.uuid4().hex}"
        found = repeated([np.concatenate(p[3]) for p in places], own_folder, least, held)
        system, path = _system(own_folder)
        if system.get_file_info(path).type == FileType.Directory:
            system.delete_dir(path)
        rows = [(doc, txt, a + lo, b + lo) for (doc, txt, lo, _, _), spans in zip(places, found) for a, b in spans]
        doc, txt, a, b = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "txt": pa.array(txt, pa.int64()), "start_word": pa.array(a, pa.int32()), "end_word": pa.array(b, pa.int32())})

    span = "doc_id long, txt long, start_word int, end_word int"
    spans = parts.where("shard >= 0").groupBy("shard").applyInArrow(sort, span)
    if not large.isEmpty():

        def windows(batches):
            for b in batches:
                own, size = np.asarray(b.column(4).flatten()).view(np.uint64), np.asarray(b.column(4).value_lengths()).astype(np.int64)
                pw, ipw = powers(len(own) + 1)
                c = np.append(np.uint64(0), np.cumsum(own * pw[: len(own)]))
                bounds = np.append(0, np.cumsum(size))
                n = np.maximum(size - least + 1, 0)
                row = np.repeat(np.arange(len(size)), n)
                at = bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                h = (c[at + least] - c[at]) * ipw[at]
                start = np.asarray(b.column(3))[row] + at - bounds[:-1][row]
                yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(start.astype(np.int32))], ["window", "doc_id", "txt", "start_word"])

        each = saved(parts.where("shard < 0").mapInArrow(windows, "window long, doc_id long, txt long, start_word int").distinct(), "windows")
        again = each.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        spans = spans.union(join_groups(each, again, ["window"]).select("doc_id", "txt", "start_word", (F.col("start_word") + least).alias("end_word")))
    # what shards and windows cover is united
    by = Window.partitionBy("txt", "doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("txt", "doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select("doc_id", "txt", "start_word", "end_word")
    whole = copies.select(F.col("txt").alias("whole")).distinct()
    spans = spans.join(whole, spans["txt"] == whole["whole"], "left_anti").select("doc_id", "start_word", "end_word")
    return spans.union(copies.select(F.col("doc").alias("doc_id"), F.lit(0).alias("start_word"), F.col("size").alias("end_word")))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(read(spark, f"{sf_dir}/documents.parquet"))
