"""Text helpers to write oracle SQL (DuckDB dialect) from the fixed rule values."""

from __future__ import annotations

from specforge.functions import regex as rx


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "i") -> str:
    return s((f"(?{flags})" if flags else "") + rx.expand(pattern))


def m(c: str, p: str, flags: str = "i") -> str:
    return f"regexp_matches({c}, {re2(p, flags)})"


def x(c: str, p: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({c}, {re2(p, flags)}, {group}), '')"


def xa(c: str, p: str, group: int = 1, flags: str = "i") -> str:
    return f"regexp_extract_all({c}, {re2(p, flags)}, {group})"


def sub(c: str, p: str, to: str = "", flags: str = "i") -> str:
    return f"regexp_replace({c}, {re2(p, flags)}, {s(to)}, 'g')"


def trim(c: str) -> str:
    return f"trim({c}, {s(rx.BLANK_CHARS)})"


def squeeze(c: str) -> str:
    return trim(f"regexp_replace({c}, {s('[' + rx.BLANK + ']+')}, ' ', 'g')")


def num(c: str) -> str:
    return f"try_cast({c} AS double)"


def rnd(c: str) -> str:
    return f"floor(({c}) + 0.5)"


def r2(c: str) -> str:
    return f"(floor(({c}) * 100.0::double + 0.5) / 100.0::double)"


def case(c: str, rules, flags: str = "i", otherwise: str = "NULL") -> str:
    """First matching (pattern, value)."""
    out = " ".join(f"WHEN {m(c, p, flags)} THEN {v if isinstance(v, bool) else s(v)}"
                   for p, v in rules)
    return f"CASE {out} ELSE {otherwise} END"


def in_list(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def mapping(c: str, table: dict, otherwise: str = "NULL") -> str:
    hits = " ".join(f"WHEN {s(k)} THEN {v if isinstance(v, (int, float)) else s(v)}"
                    for k, v in table.items())
    return f"CASE {c} {hits} ELSE {otherwise} END"


def to_num(c: str) -> str:
    return num(f"nullif(regexp_replace(cast({c} AS varchar), '[^0-9.\\-]', '', 'g'), '')")


def key_part(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def between(c: str, low, high) -> str:
    return f"CASE WHEN {c} BETWEEN {low} AND {high} THEN {c} END"
