"""Filter expressions compiled to columns.

Filters are nested lists: ["And", [f, ...]], ["Or", [f, ...]], ["Not", f] and
[attribute, operator, operand].  Every filter is true or false, never unknown: a
missing or null attribute fails each positive test and passes its complement.

Parquet can only prune on bare predicates, so a positive leaf is wrapped in
coalesce(..., false) only under an odd or even number of negations where NULL
and FALSE would part, that is under any Not; on the way from the root through
And and Or a NULL drops the row just as FALSE does.  Complements of equality use
null-safe equality, which is pushed down as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import UnsupportedPattern, glob_prefix, glob_regex, re2_regex


class FilterError(ValueError):
    """The filter is malformed."""


NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)
REF_NEW = "$ref_new."
COMPARE: dict[str, Callable[[Column, Column], Column]] = {"Lt": lambda a, b: a < b, "Lte": lambda a, b: a <= b, "Gt": lambda a, b: a > b, "Gte": lambda a, b: a >= b}
POSITIVE = {
    "Eq", "In", "Contains", "ContainsAny", "Glob", "IGlob", "Regex", "ContainsTokenSequence", "ContainsAllTokens", *COMPARE, *(f"Any{c}" for c in COMPARE),
}
COMPLEMENT = {"NotEq": "Eq", "NotIn": "In", "NotContains": "Contains", "NotContainsAny": "ContainsAny", "NotGlob": "Glob", "NotIGlob": "IGlob", "NotRegex": "Regex"}


def instant(value: object) -> datetime | None:
    """Datetime of an ISO 8601 string or of milliseconds since 1970, in UTC without a zone."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(value / 1000, timezone.utc).replace(tzinfo=None)
    if isinstance(value, str):
        try:
            return instant(datetime.fromisoformat(value.strip().replace("Z", "+00:00")))
        except ValueError:
            return None
    return None


def tokens(text: str) -> list[str]:
    """ASCII letters and digits in runs, lower case."""
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]+", lambda m: m.group().lower(), text))


def _false() -> Column:
    return F.lit(False)


def attributes(expr: object) -> set[str]:
    """Names of all attributes that a filter reads."""
    if not isinstance(expr, (list, tuple)) or not expr:
        return set()
    if expr[0] in ("And", "Or"):
        return set().union(*map(attributes, expr[1])) if len(expr) > 1 and expr[1] else set()
    if expr[0] == "Not":
        return attributes(expr[1]) if len(expr) > 1 else set()
    return {expr[0]}


class Compiler:
    """Compiles filters over the columns of one schema.

    `regex` names the attributes on which Regex is allowed (None: all).  `new`
    gives the columns that "$ref_new.x" operands stand for.
    """

    def __init__(self, schema: T.StructType, regex: set[str] | None = None, new: Callable[[str], Column] | None = None, column: Callable[[str], Column] | None = None):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.regex, self.new = regex, new
        self.column = column or (lambda name: F.col(f"`{name}`"))

    def compile(self, expr: object) -> Column:
        return self._walk(expr, True)

    def _walk(self, expr: object, bare: bool) -> Column:
        """bare: NULL may stand for FALSE here."""
        if not isinstance(expr, (list, tuple)) or not expr or not isinstance(expr[0], str):
            raise FilterError(f"no filter: {expr!r}")
        head = expr[0]
        if head in ("And", "Or") and (len(expr) == 1 or (len(expr) == 2 and isinstance(expr[1], (list, tuple)))):
            parts = [self._walk(e, bare) for e in (expr[1] if len(expr) == 2 else [])]
            if not parts:
                return F.lit(True)
            return reduce((lambda a, b: a & b) if head == "And" else (lambda a, b: a | b), parts)
        if head == "Not" and len(expr) <= 2:
            return ~self._walk(expr[1], False) if len(expr) == 2 else F.lit(True)
        if len(expr) != 3 or not isinstance(expr[1], str):
            raise FilterError(f"a comparison has an attribute, an operator and an operand: {expr!r}")
        return self._leaf(*expr, bare)

    def _leaf(self, name: str, op: str, value: object, bare: bool) -> Column:
        if op not in POSITIVE and op not in COMPLEMENT:
            raise FilterError(f"unknown operator {op!r}")
        if op in ("Regex", "NotRegex") and self.regex is not None and name not in self.regex:
            raise FilterError(f"attribute {name!r} is not enabled for Regex")
        if op in ("Eq", "NotEq") and value is None:
            c = self.column(name) if name in self.types else F.lit(None)
            return c.isNull() if op == "Eq" else c.isNotNull()
        if name not in self.types:
            return F.lit(op in COMPLEMENT)
        c, kind = self.column(name), self.types[name]
        if op == "NotEq" and not isinstance(kind, T.ArrayType) and (v := self._operand(kind, value)) is not None:
            return ~c.eqNullSafe(v)
        test = getattr(self, "_" + COMPLEMENT.get(op, op).lower(), None)
        positive = test(c, kind, value) if test else self._compare(op, c, kind, value)
        if op in COMPLEMENT:
            return ~F.coalesce(positive, _false())
        return positive if bare else F.coalesce(positive, _false())

    def _operand(self, kind: T.DataType, value: object) -> Column | None:
        """The operand as a column of a type that compares with `kind`; None if they do not compare."""
        if isinstance(value, str) and value.startswith(REF_NEW) and self.new:
            return self.new(value[len(REF_NEW) :])
        if isinstance(kind, NUMERIC):
            return F.lit(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        if isinstance(kind, T.StringType):
            return F.lit(str(value)) if isinstance(value, (str, UUID)) else None
        if isinstance(kind, T.BooleanType):
            return F.lit(value) if isinstance(value, bool) else None
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            at = instant(value)
            if at is None:
                return None
            if isinstance(kind, T.TimestampType):  # an instant, whatever the session's zone
                return F.timestamp_micros(F.lit((at - datetime(1970, 1, 1)) // timedelta(microseconds=1)))
            plain = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
            return plain if isinstance(kind, T.TimestampNTZType) else plain.cast("date")
        return None

    def _eq(self, c: Column, kind: T.DataType, value: object) -> Column:
        v = None if isinstance(kind, T.ArrayType) else self._operand(kind, value)
        return _false() if v is None else c == v

    def _in(self, c: Column, kind: T.DataType, value: object) -> Column:
        if not isinstance(value, (list, tuple)):
            return _false()
        found = [v for x in value if x is not None and (v := self._operand(kind, x)) is not None]
        test = c.isin(*found) if found else _false()
        return F.coalesce(test, _false()) | c.isNull() if None in value else test

    def _compare(self, op: str, c: Column, kind: T.DataType, value: object) -> Column:
        v = None
        if op.startswith("Any"):
            if isinstance(kind, T.ArrayType) and (v := self._operand(kind.elementType, value)) is not None:
                return F.exists(c, lambda e: COMPARE[op[3:]](e, v))
        elif value is not None and not isinstance(kind, T.ArrayType) and (v := self._operand(kind, value)) is not None:
            return COMPARE[op](c, v)
        return _false()

    def _contains(self, c: Column, kind: T.DataType, value: object) -> Column:
        if not isinstance(kind, T.ArrayType) or (v := self._operand(kind.elementType, value)) is None:
            return _false()
        return F.exists(c, lambda e: e == v)

    def _containsany(self, c: Column, kind: T.DataType, value: object) -> Column:
        if not isinstance(kind, T.ArrayType) or not isinstance(value, (list, tuple)):
            return _false()
        found = [v for x in value if x is not None and (v := self._operand(kind.elementType, x)) is not None]
        return F.exists(c, lambda e: e.isin(*found)) if found else _false()

    def _glob(self, c: Column, kind: T.DataType, value: object, fold: bool = False) -> Column:
        if not isinstance(kind, T.StringType) or not isinstance(value, str):
            return _false()
        if fold:
            c, value = F.lower(c), value.lower()
        if simple := glob_prefix(value):
            return c == F.lit(simple[0]) if simple[1] else c.startswith(simple[0])
        return c.rlike(glob_regex(value))

    def _iglob(self, c: Column, kind: T.DataType, value: object) -> Column:
        return self._glob(c, kind, value, True)

    def _regex(self, c: Column, kind: T.DataType, value: object) -> Column:
        if not isinstance(kind, T.StringType) or not isinstance(value, str):
            return _false()
        try:
            return c.rlike(re2_regex(value))
        except UnsupportedPattern:  # as one that does not compile, it matches nothing
            return _false()

    def _words(self, value: object) -> tuple[list[str], bool] | None:
        """(tokens, whether the last is a prefix) of a token operand."""
        prefix = False
        if isinstance(value, dict):
            value, prefix = value.get("query", ""), bool(value.get("last_as_prefix"))
        if isinstance(value, (list, tuple)):
            return [t for x in value if isinstance(x, str) for t in tokens(x)], prefix
        return (tokens(value), prefix) if isinstance(value, str) else None

    @staticmethod
    def _plain(c: Column) -> Column:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return F.regexp_replace(F.translate(c, upper, upper.lower()), "[^a-z0-9]+", " ")

    def _containstokensequence(self, c: Column, kind: T.DataType, value: object) -> Column:
        found = self._words(value)
        if not isinstance(kind, T.StringType) or found is None:
            return _false()
        words, prefix = found
        if not words:
            return c.isNotNull()
        text = F.concat(F.lit(" "), self._plain(c), F.lit(" "))
        return text.contains(" " + " ".join(words) + ("" if prefix else " "))

    def _containsalltokens(self, c: Column, kind: T.DataType, value: object) -> Column:
        found = self._words(value)
        if not isinstance(kind, T.StringType) or found is None:
            return _false()
        words, prefix = found
        if not words:
            return c.isNotNull()
        text = F.concat(F.lit(" "), self._plain(c), F.lit(" "))
        whole, last = (words[:-1], words[-1]) if prefix else (words, None)
        tests = [text.contains(f" {w} ") for w in dict.fromkeys(whole)] + ([text.contains(f" {last}")] if last else [])
        return reduce(lambda a, b: a & b, tests)
