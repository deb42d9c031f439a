"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model's BPE pieces become a table from (left id, right id) to the merged id
and its rank.  The words of many texts (a word starts at each marker that
follows something else) are laid out as one flat array of symbol ids, each
distinct word once.  A round looks up the ranks of all neighbouring pairs, takes
in each word the least rank (leftmost on ties: a segmented minimum over
rank and position together), merges there in all words at once and compacts the
array; words without a pair left drop out.  Symbols that are not pieces fall
back to byte pieces.  Words of over LONG symbols, for which one merge a round
would be quadratic, go through the same merges by a heap.

The model file's path is a parameter; tables are built on the driver and
broadcast (their size is the vocabulary's).

Defined cases: null text gives null ids and null decoded text, empty text no
ids; the marker character itself is encoded as a space, as the format has it;
rows are independent, so repeats and clashing columns do not matter; long texts
are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import read

from .common import HashIndex, bytes_of, lean, mix, powers, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
LONG = 192
_NONE = np.int64(1 << 30)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Bpe:
    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.encode("a b  cﬁ", out_type=str) and sp.decode(sp.encode("  xﬁ")) != "  xﬁ":
            raise ValueError("only models without text normalisation are supported")
        self.size = sp.vocab_size()
        piece = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {piece[i]: i for i in plain}
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in ids):
            raise ValueError("pieces that span words are not supported")
        if missing := {c for p in ids for c in p} - set(ids):
            raise ValueError(f"pieces hold characters that are no pieces: {sorted(missing)[:5]}")
        self.unk = sp.unk_id()
        self.byte = np.full(256, self.unk, np.int64)
        self.raw = [b""] * self.size
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(piece[i][3:5], 16)] = i
                self.raw[i] = bytes([int(piece[i][3:5], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.raw[i] = piece[i].replace(chr(MARK), " ").encode()
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
        left, right, to = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        self.base = np.int64(self.size + 0x110000)
        self.pairs = HashIndex(np.array(left, np.int64) * self.base + np.array(right, np.int64))
        self.to = np.array(to, np.int64)
        self.rank = np.array([order[-sp.get_score(i)] for i in to], np.int64)
        self.char = np.arange(0x110000, dtype=np.int64) + self.size  # unknown characters: ids beyond the vocabulary
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.ends = np.cumsum([0, *map(len, self.raw)])

    # -- encoding

    def encode_words(self, sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as character ids and bounds; (flat ids, bounds)."""
        size = np.diff(bounds)
        word = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(size > LONG):
            ids = self._heap(sym[bounds[w] : bounds[w + 1]])
            done.append((np.full(len(ids), w), ids))
        if done:
            short = size[word] <= LONG
            sym, word = sym[short], word[short]
        while len(sym):
            n = len(sym)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            at = np.full(n, -1, np.int32)
            at[:-1] = self.pairs.get((sym[:-1] * self.base + sym[1:]).view(np.uint64))
            at[np.append(start[1:], n) - 1] = -1
            value = np.where(at >= 0, self.rank[at], _NONE) << 32 | np.arange(n)
            least = np.minimum.reduceat(value, start)
            live = (least >> 32) < _NONE
            pos = (least[live] & 0xFFFFFFFF).astype(np.int64)
            sym[pos] = self.to[at[pos]]
            keep = np.repeat(live, np.diff(np.append(start, n)))
            if not live.all():
                done.append((word[~keep], sym[~keep]))
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word, kind="stable")
        return self._fall_back(word[by], sym[by], len(size))

    def _fall_back(self, word: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        cp = np.maximum(sym - self.size, 0)
        odd = sym >= self.size
        width = np.where(odd, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
        if odd.any() and (self.byte == self.unk).all():
            width, sym = np.ones_like(width), np.where(odd, self.unk, sym)
        out = np.repeat(sym, width)
        if (out >= self.size).any():
            text = "".join(map(chr, cp[odd])).encode()
            out[np.repeat(odd, width)] = self.byte[np.frombuffer(text, np.uint8)]
        return out, np.append(0, np.cumsum(np.bincount(word, width, n).astype(np.int64)))

    def _heap(self, sym: np.ndarray) -> np.ndarray:
        s = sym.tolist()
        n = len(s)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, to, base = self.rank, self.to, int(self.base)
        first = self.pairs.get((sym[:-1] * self.base + sym[1:]).view(np.uint64))
        heap = [(int(rank[k]), i, s[i], s[i + 1], int(to[k])) for i, k in enumerate(first) if k >= 0]
        heapq.heapify(heap)
        seen: dict[int, tuple[int, int] | None] = {}

        def push(i: int) -> None:
            if i >= 0 and (j := nxt[i]) >= 0:
                key = s[i] * base + s[j]
                if key not in seen:
                    k = int(self.pairs.get(np.array([key], np.uint64))[0])
                    seen[key] = (int(rank[k]), int(to[k])) if k >= 0 else None
                if got := seen[key]:
                    heapq.heappush(heap, (got[0], i, s[i], s[j], got[1]))

        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = t, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            push(prev[i])
            push(i)
        return np.array([x for x in s if x >= 0], np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, bounds) of texts given as UTF-8 bytes and offsets."""
        n = len(off) - 1
        cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(cp):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        lead = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        cb = lead[off]
        cp[cp == 0x20] = MARK
        cp = np.insert(cp, cb[:-1][np.diff(cb) > 0], MARK)
        cb = cb + np.append(0, np.cumsum(np.diff(cb) > 0))
        head = cp == MARK
        head[1:] &= cp[:-1] != MARK
        head[cb[:-1][np.diff(cb) > 0]] = True
        start = np.flatnonzero(head)
        wb = np.searchsorted(start, cb)
        end = np.append(start[1:], len(cp))
        pw, ipw = powers(len(cp) + 1)
        c = np.append(np.uint64(0), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * pw[: len(cp)]))
        _, one, of = np.unique(mix((c[end] - c[start]) * ipw[start]), return_index=True, return_inverse=True)
        size = (end - start)[one]
        bounds = np.append(0, np.cumsum(size))
        ids, ib = self.encode_words(self.char[cp[_spread(start[one], size, bounds)]], bounds)
        size = np.diff(ib)[of]
        total = np.append(0, np.cumsum(size))
        return ids[_spread(ib[:-1][of], size, total)], total[wb]

    # -- decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets); the space put before the first word is taken off."""
        size = np.diff(self.ends)[ids]
        total = np.append(0, np.cumsum(size))
        out = self.flat[_spread(self.ends[ids], size, total)]
        off = total[bounds]
        some = np.flatnonzero(np.diff(off) > 0)
        gone = some[out[off[some]] == 0x20]
        out = np.delete(out, off[gone])
        less = np.zeros(len(off), np.int64)
        less[gone + 1] = 1
        off = off - np.cumsum(less)
        try:
            out.tobytes().decode()
        except UnicodeDecodeError:
            text = [out[a:b].tobytes().decode(errors="each_byte").encode() for a, b in zip(off, off[1:])]
            return np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
        return out, off


def _spread(start: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+size[i]-1 of all i in a row; bounds: the running sum of size."""
    return np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)


def _strings(out: np.ndarray, off: np.ndarray, nulls: np.ndarray) -> pa.Array:
    a = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
    return pa.compute.if_else(pa.array(nulls), None, a).cast(pa.string()) if nulls.any() else a.cast(pa.string())


def encode_and_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded): ids of every text, and the text that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe(model))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        bpe = shared.value
        for batch in batches:
            buf, off, nulls = bytes_of(batch.column(1))
            for i, j in slices(off, 1 << 21):
                ids, bounds = bpe.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                text = _strings(*bpe.decode(ids, bounds), nulls[i:j])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                count = pa.array(np.diff(bounds), pa.int64())
                if nulls[i:j].any():
                    gone = pa.array(nulls[i:j])
                    lists, count = pa.array([None if x else y for x, y in zip(nulls[i:j], lists.to_pylist())], lists.type), pa.compute.if_else(gone, None, count)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), count, lists, text], ["doc_id", "n_tokens", "token_ids", "decoded"])

    src = docs.select(F.col("doc_id"), F.col("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, token_ids array<int>, decoded string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(read(spark, f"{sf_dir}/documents.parquet"))
