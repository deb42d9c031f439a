"""Glob and RE2 patterns as Java regular expressions."""

from __future__ import annotations

import re

_POSIX = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}",
    "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\s", "upper": "\\p{Upper}", "word": "\\w", "xdigit": "\\p{XDigit}",
}


class UnsupportedPattern(ValueError):
    """The pattern is no valid RE2 pattern."""


def quote(text: str) -> str:
    """text as a literal inside a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&~#\s])", r"\\\1", text)


def glob_parts(pattern: str) -> list[tuple[str, str]]:
    """(kind, value) pieces of a glob: text, star, any, set. An unclosed bracket is text; nothing escapes."""
    parts: list[tuple[str, str]] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if not parts or parts[-1][0] != "star":
                parts.append(("star", ""))
        elif c == "?":
            parts.append(("any", ""))
        elif c == "[":
            first = i + 1 + (pattern[i + 1 : i + 2] in ("!", "^"))
            close = pattern.find("]", first + 1 if pattern[first : first + 1] == "]" else first)
            if close < 0:
                parts.append(("text", "["))
            else:
                parts.append(("set", pattern[i + 1 : close]))
                i = close
        else:
            parts.append(("text", c))
        i += 1
    return parts


def _set(body: str) -> str:
    negate = body[:1] in ("!", "^")
    body = body[negate:]
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:
                out.append(f"{quote(body[i])}-{quote(body[i + 2])}")
            i += 3
        else:
            out.append(quote(body[i]))
            i += 1
    if not out:
        return "(?s:.)" if negate else "(?!)"
    return f"[{'^' * negate}{''.join(out)}]"


def glob_regex(pattern: str) -> str:
    """Anchored Java pattern that matches what the glob matches."""
    how = {"star": lambda _: ".*", "any": lambda _: ".", "text": quote, "set": _set}
    return "(?s)\\A" + "".join(how[k](v) for k, v in glob_parts(pattern)) + "\\z"


def glob_prefix(pattern: str) -> tuple[str, bool] | None:
    """(text, exact) if the glob is plain text, or text and a star; else None."""
    parts = glob_parts(pattern)
    star = bool(parts) and parts[-1][0] == "star"
    if any(k != "text" for k, _ in parts[: len(parts) - star]):
        return None
    return "".join(v for _, v in parts[: len(parts) - star]), not star


def re2_regex(pattern: str) -> str:
    """Java pattern of an RE2 pattern; what RE2 refuses raises."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two, rest = pattern[i : i + 2], pattern[i:]
        if two == "\\Q":
            end = pattern.find("\\E", i + 2)
            end = len(pattern) if end < 0 else end
            out.append(quote(pattern[i + 2 : end]))
            i = end + 2
            continue
        if two[:1] == "\\":
            if len(two) < 2 or two[1] in "123456789kGZ":
                raise UnsupportedPattern(pattern)
            out.append({"\\C": ".", "\\z": "\\z"}.get(two, two))
            i += 2
            continue
        if inside:
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                if m[2] not in _POSIX:
                    raise UnsupportedPattern(pattern)
                cls = _POSIX[m[2]]
                out.append(f"[^{cls}]" if m[1] else cls)
                i += m.end()
                continue
            if pattern[i] == "]":
                inside = False
            elif pattern[i] in "[&":
                out.append("\\")
            out.append(pattern[i])
        elif pattern[i] == "[":
            inside = True
            out.append("[")
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif rest.startswith("(?P<"):
            out.append("(?<")
            i += 3
        elif rest.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>")) or re.match(r"[*+?}]\+", rest):
            raise UnsupportedPattern(pattern)
        elif m := re.match(r"\(\?([imsU]*)(-[imsU]+)?([:)])", rest):
            on, off = m[1].replace("U", ""), (m[2] or "").replace("U", "").removesuffix("-")  # greed does not decide whether a text matches
            out.append("" if not on + off and m[3] == ")" else f"(?{on}{off}{m[3]}")
            i += m.end() - 1
        else:
            out.append(pattern[i])
        i += 1
    if inside:
        raise UnsupportedPattern(pattern)
    java = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP](\{\w+\}|\w)|\\[zAQE]", "x", java).replace("(?<", "(?P<"))
    except re.error as e:
        if "look-behind" not in str(e) and "flags not at the start" not in str(e):
            raise UnsupportedPattern(pattern) from e
    return java
