"""Compile rule patterns for Spark's regular expressions.

Rules are written with ASCII ``\\b`` and ``\\w``, a blank class that includes the
Unicode blanks (no-break space is common in page text), and ``.`` that stops at
line ends.  Java differs on all three, so patterns pass through `java` once, at
plan time.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = (r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}\x{FEFF}")
BLANK_CHARS = (" \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
               "\ufeff")
LINE_CHARS = r"[^\n\r\x{2028}\x{2029}]"
WORD = "[A-Za-z0-9_]"
_TOKEN = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\.|\(\?[:=!<]*[=!]?|.", re.S)


def _tokens(pattern: str) -> list[str]:
    return _TOKEN.findall(pattern)


def expand(pattern: str, boundary=None) -> str:
    """Rewrite ``\\s``, ``.`` and (with a callback) ``\\b``; classes respected."""
    toks, out, in_class = _tokens(pattern), [], False
    for i, tok in enumerate(toks):
        if in_class:
            out.append(BLANK if tok == r"\s" else tok)
            in_class = tok != "]"
        elif tok == "[":
            in_class = True
            out.append(tok)
        elif tok == r"\s":
            out.append(f"[{BLANK}]")
        elif tok == r"\S":
            out.append(f"[^{BLANK}]")
        elif tok == ".":
            out.append(LINE_CHARS)
        elif tok == r"\b" and boundary is not None:
            out.append(boundary(toks[i - 1] if i else "",
                                toks[i + 1] if i + 1 < len(toks) else ""))
        else:
            out.append(tok)
    return "".join(out)


def _ascii_boundary(prev: str, nxt: str) -> str:
    wordy_next = nxt in ("[", r"\d", r"\w") or nxt.isalnum() or nxt == "_"
    opens = nxt.startswith("(")
    at_start = prev in ("", "|") or prev.startswith("(")
    if nxt == r"\$":
        return f"(?<={WORD})"
    if (wordy_next or opens) and at_start:
        return f"(?<!{WORD})"
    if wordy_next and prev in (r"\s", "}", "?", "*", "+"):
        return f"(?<!{WORD})"
    if opens or wordy_next:
        return f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return f"(?!{WORD})"


@lru_cache(maxsize=None)
def java(pattern: str, flags: str = "i") -> str:
    """The Java form of a rule pattern; case-insensitive unless flags say so."""
    body = expand(pattern, _ascii_boundary)
    if "i" in flags and any(ord(c) > 127 and c.isalpha() for c in pattern):
        flags += "u"
    if "m" in flags:
        flags += "d"
    return (f"(?{flags})" if flags else "") + body


def any_of(patterns) -> str:
    """One alternation, so a text is scanned once for the whole list."""
    return "|".join(f"(?:{p})" for p in patterns)


def test(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.rlike(c, F.lit(java(pattern, flags)))


def pick(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """First match's group, null when there is none (Spark gives '')."""
    return F.nullif(F.regexp_extract(c, java(pattern, flags), group), F.lit(""))


def pick_num(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """First match's group as a number; the empty text of no match is no number.

    `pick` compares its value with '', which inside a lambda scans the text twice.
    """
    return F.regexp_extract(c, java(pattern, flags), group).try_cast("double")


def pick_all(c: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, flags)), F.lit(group))


def count(c: Column, pattern: str, flags: str = "i") -> Column:
    return F.regexp_count(c, F.lit(java(pattern, flags)))


def sub(c: Column, pattern: str, to: str = "", flags: str = "i") -> Column:
    return F.regexp_replace(c, java(pattern, flags), to)


def literal(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def required(pattern: str) -> str:
    """Longest literal that every match must contain, '' when there is none."""
    toks, runs, run, depth, in_class, brace = _tokens(pattern), [], "", 0, False, False
    for i, tok in enumerate(toks):
        nxt = toks[i + 1] if i + 1 < len(toks) else ""
        if in_class:
            in_class = tok != "]"
            continue
        if tok == "{" or brace:
            brace = tok != "}"
            runs.append(run)
            run = ""
            continue
        plain = len(tok) == 1 and (tok.isalnum() or tok in " -_<:,%")
        if len(tok) == 2 and tok[0] == "\\" and not tok[1].isalnum():
            plain, tok = True, tok[1]
        if tok == "|" and depth == 0 and not plain:
            return ""
        if plain and depth == 0 and nxt not in ("?", "*", "{"):
            run += tok
            if nxt != "+":
                continue
        runs.append(run)
        run = ""
        if not plain:
            depth += tok.startswith("(") - (tok == ")")
            in_class = tok == "["
    return max([*runs, run], key=len).lower()


def guard(low: Column, pattern: str, value: Column) -> Column:
    """Evaluate `value` only where the pattern's literal occurs.

    A substring search is many times cheaper than a pattern; most texts hold
    few of the many rules.
    """
    lit = required(pattern)
    return F.when(F.contains(low, F.lit(lit)), value) if lit else value


def test_low(low: Column, pattern: str) -> Column:
    """Test a rule on lower-cased text."""
    lit = required(pattern)
    if lit == pattern:
        return F.contains(low, F.lit(lit))
    hit = F.rlike(low, F.lit(java(pattern, "")))
    return F.contains(low, F.lit(lit)) & hit if lit else hit


def any_low(low: Column, patterns) -> Column:
    out = None
    for p in patterns:
        t = test_low(low, p)
        out = t if out is None else out | t
    return out


def pick_low(low: Column, c: Column, pattern: str, group: int = 1) -> Column:
    """`pick`, skipped where the pattern's literal is absent."""
    return guard(low, pattern, pick(c, pattern, group))


def pick_num_low(low: Column, c: Column, pattern: str, group: int = 1) -> Column:
    """`pick_num`, skipped where the pattern's literal is absent."""
    return guard(low, pattern, pick_num(c, pattern, group))
