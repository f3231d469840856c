"""Line-first quality rules (operator 10), DataFrame expressions only.

Rules judge each line: symbols in place of punctuation, navigation (separators),
shouting and boilerplate phrases.  A long line without a closing mark fails only if its
paragraph (lines up to a blank one) does not end in one either, so hard-wrapped prose
stays.  Failing lines go, and one blank line stays between paragraphs; a document that loses too many of its words with them is rejected, as is one that
fails the base rules (too few words, too much of it in repeated 5-word windows).

Everything stays inside the document's row: no text is shuffled or exploded.
Null or empty text: no words, so the base rules reject it.  Repeated rows and
equal lines are judged alike.  Existing columns of the added names are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge.functions.text import let
from specforge.llm.common import BLANKS, WORD, fresh

WINDOW = 5           # words of a repeated window
MIN_WORDS = 10
MAX_REPEATED = 20    # percent of the words
MIN_LEFT = 0.5       # share of the words that must survive the line rules
LONG_LINE = 12       # words from which a line must have a closing mark somewhere in its last word
SHARE = 0.3          # symbols, separators or doubled marks per word at which a line fails
SHOUT = 0.7          # capital share of the letters

BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›•·→]"
DOUBLED = "[!?]{2,}"
CLOSED = r"^[^\p{L}\p{N}.!?:;…。！？।؟]*[.!?:;…。！？।؟]"     # in the reversed text
PARAGRAPH = r"\n[ \t\n\x0B\f\r]*\n"

# Fixed phrases of page furniture, lower case.
BOILERPLATE = ("enable javascript", "accept cookies", "use of cookies", "uses cookies", "cookie policy",
               "privacy policy", "terms of use", "terms of service", "lorem ipsum", "skip to content",
               "share on facebook", "follow us on", "subscribe to our newsletter", "click here to")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice: sort the windows, keep equal neighbours,
    and add up how far each kept position reaches beyond the one before it."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.sort_array(F.transform(let(placed, lambda s: F.filter(
        s, lambda x, i: F.coalesce(x.h == F.get(s, i - 1).h, F.lit(False))
        | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False)))), lambda x: x.i))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(twice, start, lambda acc, i: F.struct(
        (acc.n + F.least(F.lit(WINDOW), i - acc.last)).alias("n"), i.alias("last")), lambda acc: acc.n)


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the array holds twice or more, first ones included.

    Windows are compared by 64-bit hashes of their words.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _repeated(g)).otherwise(F.lit(0))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows(w), count)))


def _closed(text: Column) -> Column:
    """Whether no letter or digit follows the last closing mark; read from the end."""
    return F.rlike(F.reverse(text), F.lit(CLOSED))


def _phrases(low: Column) -> Column:
    return F.rlike(low, F.lit("|".join(BOILERPLATE)))


def _marked(line: Column, phrases: Column) -> Column:
    """Whether a line fails by itself; `phrases` tells whether to look for boilerplate in it."""
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(f"{SYMBOLS}|{DOUBLED}"))
    navigation = F.regexp_count(line, F.lit(SEPARATORS))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    least = F.greatest(SHARE * n, F.lit(2))
    return ((marks >= least) | (navigation >= least) | ((n >= 5) & (capitals > 0) & (capitals > SHOUT * letters))
            | (phrases & _phrases(F.lower(line))))


def _open(line: Column) -> Column:
    return (F.regexp_count(line, F.lit(WORD)) >= LONG_LINE) & ~_closed(line)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word and stands alone goes."""
    return _marked(line, F.lit(True)) | _open(line)


def clean(text: Column) -> Column:
    """The lines of a text that pass, with a blank line between paragraphs."""
    def paragraph(p: Column, phrases: Column) -> Column:
        lines = F.filter(F.split(p, "\n"), lambda l: F.rlike(l, F.lit(WORD)) & ~_marked(l, phrases))
        return let(lines, lambda kept: F.array_join(
            F.when(_closed(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))), kept)
            .otherwise(F.filter(kept, lambda l: ~_open(l))), "\n"))

    # Most texts have no phrase at all: then no line is searched for one.
    some = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE)))
    return let(some, lambda phrases: F.array_join(F.filter(
        F.transform(F.split(text, PARAGRAPH), lambda p: paragraph(p, phrases)), lambda p: p != ""), "\n\n"))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the base measures, `base_failed`, `kept`, and `cleaned`, the text
    of the lines that pass."""
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda l: F.rlike(l, F.lit(WORD)))
    words = _words(source)
    out = df.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.regexp_count(source, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda l: F.size(l) - F.size(F.array_distinct(l))).cast("bigint"),
        "n_repeat_words": repeat_words(words).cast("bigint"),
        "cleaned": clean(source),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    left = F.regexp_count("cleaned", F.lit(WORD))
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT * F.col("n_words")))


def judge(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures and verdict per document, without the text."""
    return measured(df.select(doc, text), text).select(
        doc, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """Documents that stay, with the columns they came with and the text of their passing lines.

    The verdict is one expression under a generator, so that no filter repeats its work.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    cleaned = clean(source)
    none = F.array().cast("array<string>")

    def verdict(m: Column) -> Column:
        stays = ((m.n >= MIN_WORDS) & (100 * m.repeated <= MAX_REPEATED * m.n)
                 & (F.regexp_count(m.cleaned, F.lit(WORD)) >= MIN_LEFT * m.n))
        return F.when(stays, F.array(m.cleaned)).otherwise(none)

    measures = let(_words(source), lambda w: F.struct(
        F.size(w).alias("n"), repeat_words(w).alias("repeated"), cleaned.alias("cleaned")))
    new = fresh(df, "cleaned")
    out = df.select("*", F.explode(let(measures, verdict)).alias(new))
    changed = {text: F.col(new)}
    if n_chars is not None:
        changed[n_chars] = F.length(F.col(new)).cast(df.schema[n_chars].dataType)
    return out.withColumns(changed).select(*df.columns)
