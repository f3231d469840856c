"""Scalar column functions: strings, numbers, booleans, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specforge.functions import regex as rx


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(rx.BLANK_CHARS))


def norm_str(c: Column) -> Column:
    """Trim; empty becomes null."""
    return F.nullif(trim(c.cast("string")), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return trim(F.regexp_replace(c, f"[{rx.BLANK}]+", " "))


def to_num(c: Column) -> Column:
    """Keep digits, dot and minus, then parse; anything unparsable is null."""
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")
    return F.nullif(kept, F.lit("")).try_cast("double")


def js_round(c: Column) -> Column:
    """Half towards plus infinity: -2.5 becomes -2."""
    return F.floor(c + F.lit(0.5)).cast("double")


def round_to(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round2(c: Column) -> Column:
    return round_to(c, 2)


def to_int(c: Column) -> Column:
    return F.floor(to_num(c) + F.lit(0.5))


def to_positive_int(c: Column) -> Column:
    """Digits only; null unless greater than zero."""
    digits = F.nullif(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit(""))
    n = digits.try_cast("bigint")
    return F.when(n > 0, n)


def guarded_bigint(c: Column) -> Column:
    """Cast only an all-digit text."""
    return F.when(F.rlike(c, F.lit("^[0-9]+$")), c.try_cast("bigint"))


def to_iso_date(c: Column) -> Column:
    """`YYYY-MM-DD` kept as it is, other parsable stamps cut to the UTC day."""
    s = norm_str(c)
    parsed = F.coalesce(
        s.try_cast("timestamp"),
        F.try_to_timestamp(s, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(s, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(s, F.lit("M/d/yyyy")))
    return F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), s).otherwise(
        F.date_format(parsed, "yyyy-MM-dd"))


def to_bool(c: Column) -> Column:
    """true/yes/1, false/no/0, any other number by being non-zero."""
    s = F.lower(trim(c.cast("string")))
    n = s.try_cast("double")
    return (F.when(s.isin("true", "yes", "1"), True)
            .when(s.isin("false", "no", "0"), False)
            .when(n.isNotNull(), n != 0))


def sanitize(c: Column, max_chars: int | None = None) -> Column:
    """Drop control characters, collapse blanks; cut the field only if asked to."""
    clean = squeeze(F.regexp_replace(c.cast("string"), r"[\x00-\x1F\x7F-\x9F]", ""))
    return F.nullif(clean if max_chars is None else F.substring(clean, 1, max_chars), F.lit(""))


def sheet_number(c: Column) -> Column:
    """'9.9 oz (282g)' prefers the grams; otherwise strip and round."""
    usable = F.when(~c.isin("", "N/A"), c)
    grams = rx.pick(usable, r"\((\d+(?:\.\d+)?)g?\)", flags="")
    kept = F.regexp_replace(usable, r"[^0-9.\-]", "")
    number = F.nullif(F.regexp_extract(kept, r"^(-?\d*\.?\d+)", 1), F.lit(""))
    return js_round(F.coalesce(grams, number).try_cast("double"))


def drop_placeholders(c: Column, values) -> Column:
    return F.when(~F.lower(c).isin(list(values)), c)


def enum(c: Column, allowed) -> Column:
    s = F.lower(trim(c))
    return F.when(s.isin(list(allowed)), s)


def vocab(c: Column, rules, default=None) -> Column:
    """First matching (pattern, value) of a vocabulary; case-insensitive."""
    s = F.lower(c)
    out = None
    for pattern, value in rules:
        out = (F if out is None else out).when(rx.test(s, pattern, ""), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def lookup(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """A literal map; for tables that do not fit a plan, join instead."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.element_at(F.create_map(*pairs), c)
    return F.coalesce(hit, default) if default is not None else hit


def contains_any(c: Column, terms) -> Column:
    """Substring test for a list, as one alternation over the text."""
    return F.rlike(c, F.lit("|".join(rx.literal(t) for t in terms)))


def sum_of(cols) -> Column:
    out = None
    for c in cols:
        out = c if out is None else out + c
    return out


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


def let(value: Column, body) -> Column:
    """Bind a computed value once for use inside nested lambdas.

    The optimizer may inline a column into a lambda, where it would run again
    for every element; a lambda variable is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail(arr: Column) -> Column:
    """All items but the first."""
    return F.slice(arr, 2, 1_000_000_000)
