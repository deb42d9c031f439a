"""Stemmers after the published Snowball algorithms: English (Porter2), Swedish, Norwegian."""

from __future__ import annotations

import re

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Place after the first other letter that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL


def english(word: str) -> str:
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return word
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, _VOWEL)
    r2 = _after(w, _VOWEL, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    # 1b
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and any(c in _VOWEL for c in w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and not (end == "ogi" and w[at - 1 : at] != "l") and not (end == "li" and w[at - 1 : at] not in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and not (end == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _nordic_r1(w: str, vowels: str) -> int:
    return max(_after(w, vowels), min(3, len(w)))


def _cut(w: str, r1: int, ends: tuple[str, ...]) -> str | None:
    """w without the longest of the endings that lies in R1."""
    for end in sorted(ends, key=len, reverse=True):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[: -len(end)]
    return None


_SV1 = tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split())


def swedish(word: str) -> str:
    w, vowels = word, "aeiouyåäö"
    r1 = _nordic_r1(w, vowels)
    cut = _cut(w, r1, _SV1)
    if cut is not None:
        w = cut
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2:-1] in tuple("bcdfghjklmnoprtvy"):
        w = w[:-1]
    if w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")) and len(w) - 2 >= r1:
        w = w[:-1]
    for end in ("lig", "els", "ig"):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[: -len(end)]
    for end, new in (("fullt", "full"), ("löst", "lös")):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[: -len(end)] + new
    return w


_NO1 = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split())


def norwegian(word: str) -> str:
    w, vowels = word, "aeiouyæåø"
    r1 = _nordic_r1(w, vowels)
    if w.endswith(("erte", "ert")) and len(w) - (4 if w.endswith("erte") else 3) >= r1:
        w = w[:-2] if w.endswith("erte") else w[:-1]
    elif (cut := _cut(w, r1, _NO1)) is not None:
        w = cut
    elif w.endswith("s") and len(w) - 1 >= r1 and (w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (w[-2:-1] == "k" and w[-3:-2] not in vowels)):
        w = w[:-1]
    if w.endswith(("dt", "vt")) and len(w) - 2 >= r1:
        w = w[:-1]
    cut = _cut(w, r1, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
    return w if cut is None else cut


STEMMERS = {"english": english, "swedish": swedish, "norwegian": norwegian}
