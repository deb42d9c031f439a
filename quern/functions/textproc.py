"""Full-text tokenizers as columns, stop words, folding and stemming.

Order of work: lower case, tokens, stop words out, stems.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import STEMMERS

TOKENIZERS = ("word_v3", "whitespace", "character", "ngram")
_FOLD = dict(zip("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaaceeeeiiiinoooooouuuuyy"))
_UPPER = {k.upper(): v.upper() for k, v in _FOLD.items() if k != "ÿ"}
#: Stop words as indexes of this kind have them, in alphabetical order; transliterated where the language has another script.
STOP_WORDS = {
    "english": "a all also an and any are as at be been being but by can did do does each for from had has have he how i if in is it its just me more most my no not now of on only or other our own same should so some such than that the their they this to too very was we were what when where which who why will with you your",
    "spanish": "al como con de del el en es la las los o para pero por que sin son su sus un una unas unos y",
    "french": "au aux avec de des du en est et la le les ou par pour que sans sont un une",
    "german": "als am auch auf das der die ein eine im in ist mit nicht oder sind und von zu",
    "italian": "che con del della di e gli i il in la le lo o per sono su un una",
    "portuguese": "a as com da de do e em nao o os ou para por que sao sem um uma umas uns",
    "dutch": "aan als bij de een en het in met niet of op van voor wel",
    "russian": "a da i ili k my na ne no on ona oni ono po s ty v vo vy ya",
    "swedish": "att den det en for han hon i jag med och pa sig som var",
    "norwegian": "at den det en for han hun i jeg med og pa seg som var",
    "danish": "at den det en for han hun i jeg med og pa seg som var",
    "finnish": "ei ett he ja me mina olen oli on se sin tassa te tuo",
    "arabic": "al an bi fi ila lan li ma min wa",
    "chinese": "bu de le men ni shi ta wo ye zai",
    "japanese": "de ga ka mo ni no shi to wa wo",
    "korean": "eseo eul ga geu gwa ha i reul ui wa",
}


class FtsError(ValueError):
    """The full-text settings are malformed."""


@dataclass(frozen=True)
class Fts:
    """Full-text settings of an attribute."""

    tokenizer: str = "word_v3"
    language: str = "english"
    case_sensitive: bool = False
    stemming: bool = True
    remove_stopwords: bool = True
    ascii_folding: bool = False
    k1: float = 1.2
    b: float = 0.75
    stop: frozenset = field(init=False, default=frozenset())

    def __post_init__(self):
        if self.tokenizer not in TOKENIZERS:
            raise FtsError(f"unknown tokenizer {self.tokenizer!r}")
        if self.language not in STOP_WORDS:
            raise FtsError(f"unknown language {self.language!r}")
        if not 0 <= self.k1 <= 10 or not 0 <= self.b <= 1:
            raise FtsError("k1 lies between 0 and 10, b between 0 and 1")
        if self.remove_stopwords:
            object.__setattr__(self, "stop", frozenset(STOP_WORDS[self.language].split()))

    @staticmethod
    def parse(value: object) -> Fts | None:
        if value is None or value is False:
            return None
        if value is True:
            return Fts()
        if isinstance(value, dict):
            try:
                return Fts(**value)
            except TypeError as e:
                raise FtsError(str(e)) from e
        raise FtsError(f"full_text_search is a flag or an object, not {value!r}")


def fold(c: Column) -> Column:
    """Latin letters without their marks."""
    table = _FOLD | _UPPER
    return F.replace(F.translate(c, "".join(table), "".join(table.values())), F.lit("ß"), F.lit("ss"))


def tokenize(c: Column, fts: Fts) -> Column:
    """Array of the tokens of a text, in order and with repeats; NULL stays NULL."""
    text = c if fts.case_sensitive else F.lower(c)
    if fts.ascii_folding:
        text = fold(text)
    if fts.tokenizer == "word_v3":
        out = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}_]+)"), F.lit(1))
    elif fts.tokenizer == "whitespace":
        out = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    elif fts.tokenizer == "character":
        out = F.filter(F.split(text, ""), lambda t: ~t.rlike(r"(?U)^\s*$"))
    else:
        # a look-ahead at every place gives all windows in one pass; bound as a lambda's variable, the text is made once
        grams = lambda t: F.when(F.char_length(t) >= 3, F.regexp_extract_all(t, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"), F.lit(1))).when(t != "", F.array(t)).when(t == "", F.array().cast("array<string>"))
        out = F.transform(F.array(F.translate(text, " ", "")), grams)[0]
    if fts.stop:
        out = F.filter(out, lambda t: ~F.lower(t).isin(*sorted(fts.stop)))
    return out


def terms_of(text: str, fts: Fts) -> list[str]:
    """The tokens of a query text, worked out on the driver like those of the documents."""
    import regex

    text = text if fts.case_sensitive else text.lower()
    if fts.ascii_folding:
        table = _FOLD | _UPPER | {"ß": "ss"}
        text = "".join(table.get(ch, ch) for ch in text)
    if fts.tokenizer == "word_v3":
        out = regex.findall(r"[\p{L}\p{Nd}_]+", text)
    elif fts.tokenizer == "whitespace":
        out = text.split()
    elif fts.tokenizer == "character":
        out = [ch for ch in text if not ch.isspace()]
    else:
        text = text.replace(" ", "")
        out = [text[i : i + 3] for i in range(len(text) - 2)] or ([text] if text else [])
    out = [t for t in out if t.lower() not in fts.stop]
    step = STEMMERS.get(fts.language) if fts.stemming else None
    return [step(t) for t in out] if step else out
