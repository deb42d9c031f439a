"""Personal data: offset-preserving deobfuscation.

A chain of transducers rewrites a text into a plain form while every produced
character keeps the source range it came from: look-alike characters and
Unicode digits become ASCII, invisible characters vanish, bracketed or spoken
"at"/"dot" become @ and ., runs of spelled digits become digits.  Identifiers
are found in the plain form and their spans mapped back to source characters.

Kinds: EMAIL, CARD (13-19 digits passing the Luhn test), IP (v4), IBAN
(mod 97), SSN, PHONE (ten digits in groups, or + and 8-15 digits; or 7-15 spelled
digits), SECRET (the value after a password/token/key name).  Earlier
kinds win overlaps.

Texts in which nothing can be found are told apart first, by bytes, key words and
forms (`suspects`); all others are examined whole, however long: 8 bytes a
character hold the source ranges.

Defined cases: a null text stays null with no spans; an empty one stays empty;
spans count code points of the source, half open, ordered and disjoint; rows are
handled one by one, so repeats and ties do not matter; only doc_id and text are
read, so columns named spans or redacted do not clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from quern.sources.tables import read

from .common import HashIndex, lean, segment_sum, span_hash, texts, word_bounds

_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_LOOKS = dict(zip("АВСЕНІЈКМОРЅТХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα∙․⋅‐‑‒–—−", "ABCEHIJKMOPSTXaeopcyxijshdqwABEZHIKMNOPTYXoa...------"))


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _LOOKS.items()}
    for c in [*range(0xB2, 0xBA), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x2070, 0x208A), *range(0x2460, 0x2469), *range(0xFE52, 0xFE6C), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        flat = unicodedata.normalize("NFKC", chr(c))
        try:
            flat = str(unicodedata.digit(chr(c)))
        except ValueError:
            pass
        if len(flat) == 1 and flat.isascii():
            table[c] = flat
    for space in "    ":
        table[ord(space)] = " "
    return table


FOLD = _fold_table()
_TLD = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|biz|me|dev|app|example|test"
_WORDS = "|".join(_DIGIT_WORDS)
_DOT = "dot|punkt|punto|point"
_SEEN = np.zeros(256, bool)  # bytes that an identifier has, or leads of characters that fold or are digits to a pattern
_SEEN[48:58] = _SEEN[64] = True
_SEEN[list({chr(c).encode()[0] for c in FOLD if c > 0xFF and not chr(c).isspace() and c not in (0x2013, 0x2014)})] = True
_SEEN[list({chr(c).encode()[0] for c in range(0x100, 0x110000) if unicodedata.category(chr(c)) == "Nd"})] = True
#: Key words of secrets and spoken dots; then characters of common leads that fold, vanish, are blank or, ignoring case, equal an ASCII letter.
_KEYS = [k.encode() for k in ("dot", "punkt", "punto", "point", "password", "passwd", "pwd", "token", "secret", "key", *"\xad\xa0\x85\xb2\xb3\xb9\u0130\u0131\u017f\u3000")]
_KEYS = [k for k in _KEYS if not _SEEN[k[0]]]
_BLANK = rb"[\s\x1c-\x1f]{0,3}"
#: What is left of the disguises and secrets when a text has none of the above, over lower-cased bytes.
_FORMS = [
    re.compile(rb"[\[({<]" + _BLANK + rb"(?:at|arroba|\.)" + _BLANK + rb"[\])}>]"),
    re.compile(rb" at (?:[a-z0-9-]{1,63}\.){1,6}(?:" + _TLD.encode() + rb")"),
    re.compile(rb"akia[a-z]{16}|gh[pousr]_[a-z]{36}|sk-[a-z_-]{20}"),
]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _index_of(names: list[str]) -> HashIndex:
    raw = [x.encode() for x in names]
    ends = np.cumsum([0, *map(len, raw)])
    return HashIndex(span_hash(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:]))


_DIGITS = _index_of(list(_DIGIT_WORDS))
_SPELLED = re.compile(rf"\b(?:{_WORDS}|\d)(?:[\s,.-]{{1,2}}(?:{_WORDS}|\d)){{3,}}\b", re.I)
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|arroba|@)\s{0,3}[\])}>]\s{0,3}", re.I)
_DOTB = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_SPOKEN = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?: at |@)(?:[A-Za-z0-9-]{{1,63}}(?: (?:{_DOT}) |\.)){{1,6}}(?:{_TLD})\b", re.I)
_SPOKEN_PART = re.compile(rf" at | (?:{_DOT}) ", re.I)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}\b")
_CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])")
_WORLD = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)")
_SECRET = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|secret[_ -]?key|private[_ -]?key)[\"']?\s{0,3}(?:=|:|:=|=>)\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)
_KEYLIKE = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})\b")


class Plain:
    """A rewritten text; character i came from source range [lo[i], hi[i])."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi = text, np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32)
        self.spoken: list[tuple[int, int]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        if not edits:
            return
        out, lo, hi, at = [], [], [], 0
        for a, b, new in edits:
            out += (self.text[at:a], new)
            lo += (self.lo[at:a], np.full(len(new), self.lo[a], np.int32))
            hi += (self.hi[at:a], np.full(len(new), self.hi[b - 1], np.int32))
            at = b
        self.text = "".join(out) + self.text[at:]
        self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])


def plain(text: str) -> Plain:
    p = Plain(text.translate(FOLD))
    p.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(p.text)])
    p.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(p.text)])
    p.rewrite([(m.start(), m.end(), ".") for m in _DOTB.finditer(p.text)])
    edits = []
    for m in _SPOKEN.finditer(p.text):
        word = m.group()
        parts = list(_SPOKEN_PART.finditer(word))
        name = word.split(" at ")[0]
        # "see us at place.com" speaks of a site: a lone spoken "at" needs a name that is not a plain word.
        if len(parts) == 1 and "@" not in word and not re.search(r"[\d._%+-]", name):
            continue
        edits += [(m.start() + x.start(), m.start() + x.end(), "@" if x.group().strip().lower() == "at" else ".") for x in parts]
    p.rewrite(edits)
    edits = []
    for m in _SPELLED.finditer(p.text):
        if len(re.findall(_WORDS, m.group(), re.I)) >= 3:
            edits.append((m.start(), m.end(), re.sub(r"\D", "", re.sub(_WORDS, lambda w: _DIGIT_WORDS[w.group().lower()], m.group(), flags=re.I))))
    spoken, moved = [], 0
    for a, b, new in edits:
        spoken.append((a + moved, a + moved + len(new)))
        moved += len(new) - (b - a)
    if edits:  # each digit keeps the word that it came from
        lo_of = {}
        for a, b, _ in edits:
            lo_of[a] = [(p.lo[a + x.start()], p.hi[a + x.end() - 1]) for x in re.finditer(rf"{_WORDS}|\d", p.text[a:b], re.I)]
        p.rewrite(edits)
        for (s, e), (a, _, _) in zip(spoken, edits):
            for i, (lo, hi) in zip(range(s, e), lo_of[a]):
                p.lo[i], p.hi[i] = lo, hi
    p.spoken = spoken
    return p


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x // 5 + 2 * x % 10 for x in d[1::2])) % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """Source spans of identifiers and their kinds, in order and disjoint."""
    if not text:
        return []
    p = plain(text)
    t, found = p.text, []
    if "@" in t:
        found += [(m.start(), m.end(), "EMAIL") for m in _EMAIL.finditer(t)]
    found += [(m.start(1), m.end(1), "SECRET") for m in _SECRET.finditer(t)]
    found += [(m.start(), m.end(), "SECRET") for m in _KEYLIKE.finditer(t)]
    found += [(m.start(), m.end(), "CARD") for m in _CARD.finditer(t) if luhn(re.sub(r"\D", "", m.group()))]
    found += [(m.start(), m.end(), "IP") for m in _IP.finditer(t)]
    for m in _IBAN.finditer(t):  # words in capitals may follow
        end = m.end()
        while end > m.start() and not _iban(t[m.start() : end]):
            end = t.rfind(" ", m.start(), end)
        if end > m.start():
            found.append((m.start(), end, "IBAN"))
    found += [(m.start(), m.end(), "SSN") for m in _SSN.finditer(t)]
    found += [(m.start(), m.end(), "PHONE") for m in _PHONE.finditer(t)]
    found += [(m.start(), m.end(), "PHONE") for m in _WORLD.finditer(t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    found += [(a, b, "PHONE") for a, b in p.spoken if 7 <= b - a <= 15]
    kept: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))
    for a, b, kind in found:
        if not taken.count(1, a, b):
            taken[a:b] = b"\1" * (b - a)
            kept.append((int(p.lo[a]), int(p.hi[b - 1]), kind))
    return sorted(kept)


def suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text may hold an identifier: has a telling byte, key word or form, or two digit words in a row; true wherever find() finds."""
    n = len(off) - 1
    if not len(buf):
        return np.zeros(n, bool)
    hit = segment_sum(_SEEN[buf], off) > 0
    low = _LOWER[buf]
    raw = low.tobytes()
    for key in _KEYS:
        at = raw.find(key)
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            hit[row] = True
            at = raw.find(key, int(off[row + 1]))
    for form in _FORMS:
        m = form.search(raw)
        while m:
            row = int(np.searchsorted(off, m.start(), "right")) - 1
            hit[row] = True
            m = form.search(raw, int(off[row + 1]))
    s, e = word_bounds(low, off)
    few = np.flatnonzero(e - s <= 5)
    s, e = s[few], e[few]
    word = _DIGITS.get(span_hash(low, s, e)) >= 0
    pair = np.flatnonzero(word[1:] & word[:-1] & (s[1:] - e[:-1] <= 2))
    hit[np.searchsorted(off, s[pair], "right") - 1] = True
    return hit


def _found(col: pa.Array) -> dict[int, tuple[str, list[tuple[int, int, str]]]]:
    """Rows with identifiers: text and spans."""
    out = {}
    for i, _, buf, off in texts(col):
        for row in np.flatnonzero(suspects(buf, off)):
            text = buf[off[row] : off[row + 1]].tobytes().decode()
            if spans := find(text):
                out[i + int(row)] = text, spans
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += (text[at:a], f"<{kind}>")
        at = b
    return "".join(out) + text[at:]


def _replaced(col: pa.Array, new: dict[int, object]) -> pa.Array:
    if not new:
        return col
    mask = np.zeros(len(col), bool)
    mask[list(new)] = True
    return pa.compute.replace_with_mask(col, pa.array(mask), pa.array([new[i] for i in sorted(new)], col.type))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def deobfuscate(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, redacted) of every row."""

    def run(batches):
        for b in batches:
            found = _found(b.column(1))
            rows: list[list] = [[] for _ in range(b.num_rows)]
            for i, (_, spans) in found.items():
                rows[i] = [{"start": a, "end": e, "kind": k} for a, e, k in spans]
            text = _replaced(b.column(1), {i: redact(*x) for i, x in found.items()})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPANS), text], ["doc_id", "spans", "redacted"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>, redacted string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the identifiers in `text` replaced by their kinds; `n_chars`, if there, follows where the text changed."""
    at = docs.columns.index("text")
    n = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            new = {i: redact(*x) for i, x in _found(b.column(at)).items()}
            cols = list(b.columns)
            cols[at] = _replaced(cols[at], new)
            if n is not None:
                cols[n] = _replaced(cols[n], {i: len(x) for i, x in new.items()})
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return deobfuscate(read(spark, f"{sf_dir}/documents.parquet"))
