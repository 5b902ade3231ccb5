"""Text expressions. Every helper is a native Spark expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The six characters that a JVM regex counts as white space.
WS = r"[ \t\n\x0B\f\r]"


def trim_ws(c: Column) -> Column:
    """Strip every leading and trailing character up to U+0020.

    Most ends hold blanks at most; only other control characters need the pattern.
    """
    blank = F.trim(c)
    clean = (blank >= "!") & (F.substring(blank, -1, 1) >= "!")
    return F.when(clean, blank).otherwise(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def single_space_tokens(c: Column) -> Column:
    """Split at every single white-space character; inner empty tokens stay, trailing ones go."""
    return F.split(F.regexp_replace(c, WS + "+$", ""), WS)


def words(c: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def paragraphs(c: Column, keep_empty: bool = False) -> Column:
    trimmed = F.transform(F.split(c, "\n+"), trim_ws)
    return trimmed if keep_empty else F.filter(trimmed, lambda p: p != "")


def single_spaces(c: Column) -> Column:
    """Every run of white space as one blank; a run that is one blank already is passed over."""
    return F.regexp_replace(c, rf" {WS}+|[\t\n\x0B\f\r]{WS}*", " ")


def one_line(c: Column) -> Column:
    return trim_ws(single_spaces(c))


def _throughout(c: Column, mark: str, window: int) -> Column:
    """Equal to sliding a window: one without the mark exists exactly when two marks lie that far apart."""
    long_gap = F.exists(F.split(c, mark), lambda gap: F.length(gap) >= window)
    return ~long_gap & ((F.length(c) >= window) | F.contains(c, F.lit(mark)) | (F.length(c) == 0))


def has_charset_throughout(c: Column, charset: str, window: int, require_space: bool = False) -> Column:
    """True when every ``window``-long stretch of the lower-cased text holds a charset letter."""
    mark = charset[0]
    low = F.translate(F.lower(c), charset, mark * len(charset))
    ok = _throughout(low, mark, window)
    if require_space:
        ok = ok & _throughout(low, " ", window)
    return ok


def digest(c: Column) -> Column:
    """32-byte content key; comparing digests stands in for comparing long texts."""
    return F.unhex(F.sha2(c, 256))


def sentences(c: Column) -> Column:
    """Split a text into sentences.

    A boundary is a run of closing marks (or a list mark such as ``a)``),
    spaces and an optional quote, before a capital letter or a digit.
    """
    from lexispark.functions.alphabets import SENTENCE_START

    flat = single_spaces(F.replace(c, F.lit("\u00a0"), F.lit(" ")))
    marked = F.regexp_replace(
        flat, rf'((?:[.?!…;:+-]+|[abcdef]\)) +["“]?)([{SENTENCE_START}])', "$1\n$2"
    )
    return F.filter(F.transform(F.split(marked, "\n"), trim_ws), lambda s: s != "")
