"""Syllable parts, sub-tokens, characters and word routing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexispark.functions.alphabets import (
    FOREIGN_CONSONANTS,
    MARKED_FROM,
    MARKED_TO,
    VOWELS_PLAIN,
)

_VOWEL = f"[{VOWELS_PLAIN}{VOWELS_PLAIN.upper()}]"
_NOT_VOWEL = f"[^{VOWELS_PLAIN}{VOWELS_PLAIN.upper()}]"
# Words are runs of letters, digits and underscores; any other visible character stands alone.
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
# Marks routed as punctuation.
PUNCTUATION = r"""[,.;:'?"`!@#$%^&*)()}{|~/\\+=-]+"""


def syllable_parts(word: Column, max_chars: int | None = 7) -> Column:
    """Onset, nucleus and coda, empty ones left out; a longer word stays whole."""
    # Marks are removed one for one, so that a short character class finds every vowel.
    base = F.translate(word, MARKED_FROM + MARKED_FROM.upper(), MARKED_TO + MARKED_TO.upper())
    n = F.length(word)
    onset = F.length(F.regexp_extract(base, f"^{_NOT_VOWEL}*", 0))
    coda = F.when(onset < n, F.length(F.regexp_extract(base, f"{_NOT_VOWEL}*$", 0))).otherwise(0)
    parts = F.filter(
        F.array(
            F.substring(word, F.lit(1), onset),
            F.substring(word, onset + 1, n - onset - coda),
            F.substring(word, n - coda + 1, coda),
        ),
        lambda p: p != "",
    )
    if max_chars is None:
        return parts
    return F.when(F.length(word) > max_chars, F.array(word)).otherwise(parts)


def subtoken_triple(word: Column) -> Column:
    """First character, middle, last character; `$NA` fills what a short word lacks."""
    n = F.length(word)
    na = F.lit("$NA")
    first, last = F.substring(word, 1, 1), F.right(word, F.lit(1))
    middle = F.substring(word, F.lit(2), n - 2)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(word, na, na))
        .when(n == 2, F.array(first, na, last))
        .otherwise(F.array(first, middle, last))
    )


def padded_characters(word: Column, size: int = 13, pad: str = "$P") -> Column:
    letters = F.filter(F.split(word, ""), lambda ch: ch != "")
    filled = F.slice(F.concat(letters, F.array_repeat(F.lit(pad), size)), 1, size)
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(filled)


def strip_diacritics(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED_FROM, MARKED_TO)


def character_class(token: Column) -> Column:
    """`0` for numbers, the token when its first character is a known letter, else `S`."""
    known = MARKED_FROM + "".join(sorted(set(MARKED_TO)))
    known = known + known.upper()
    return (
        F.when(token.rlike(r"^[+-]?[0-9]+([.,]\d+)*$"), "0")
        .when(F.substring(token, 1, 1).rlike(f"^[{known}]"), token)
        .otherwise("S")
    )


def matches_with_gaps(c: Column, pattern: str) -> Column:
    """array<struct<gap, match>>: every match with the text since the match before it."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(c, pattern), F.lit(1), F.size(found))
    return F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))


def route(word: Column, in_dictionary: Column) -> Column:
    """Language route of a word: vie, eng or unk; first rule that holds."""
    low = F.lower(word)
    return (
        F.when(F.length(word) > 7, "eng")
        .when(low.rlike(f"[{FOREIGN_CONSONANTS}]"), "eng")
        .when(F.length(F.translate(low, MARKED_FROM, "")) < F.length(low), "vie")
        .when(in_dictionary, "vie")
        .when(word.rlike(f"^{PUNCTUATION}$"), "vie")
        .when(word.rlike(r"^\p{Nd}+$"), "vie")
        .when(word.rlike(r"^[\x00-\x7F]*$"), "eng")
        .otherwise("unk")
    )


def routed_pieces(word: Column, language: Column) -> Column:
    """vie: syllable parts; eng: first, middle and last part; unk: the word itself."""
    thirds = F.filter(subtoken_triple(word), lambda p: p != "$NA")
    return (
        F.when(language == "vie", syllable_parts(word, None))
        .when(language == "eng", thirds)
        .otherwise(F.array(word))
    )
