"""Scalar text expressions (JVM-side, inside whole-stage codegen).

Covers the ASCII predicate, the basic correction chain, word tokenisation and
n-gram construction. Everything here returns a ``Column``; nothing runs in
Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that reproduce Python's Unicode ``\s``,
# ``\w`` and ``\W`` in Java regular expressions (Java's plain classes are
# ASCII-only; ``(?U)`` counts combining marks as word characters, Python does
# not).
WS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NOT_SPACE = WS.replace("\\x{20}", "\\x{1f}")
WORD = "[\\p{L}\\p{N}_]"
NONWORD = "[^\\p{L}\\p{N}_]"
# A token is a maximal run of letters and digits.
TOKEN = "[\\p{L}\\p{N}]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ascii(col: Column | str) -> Column:
    """True when every code point is in 0..127 (the empty string is ASCII)."""
    return ~_c(col).rlike("[^\\x00-\\x7F]")


def correct_text(col: Column | str) -> Column:
    """Basic correction of a review, step by step:

    a. lowercase;
    b. strip Unicode whitespace at both ends;
    c. collapse whitespace runs to one space;
    d. a letter a-z repeated three or more times becomes one (doubles stay);
    e. an identical non-word character repeated becomes one;
    f. a (lazy) run of non-word characters ending in a period becomes the period;
    g. a space is inserted after ``. ? ! ,`` when a word character follows;
    h. whitespace before ``? . ! , ; : "`` is dropped when whitespace or the
       end of the text follows the mark.
    """
    s = F.lower(_c(col))
    # b and c: only runs that are not one space already are replaced, then at most one space is left at an end
    s = F.trim(F.regexp_replace(s, f" {WS}++|(?![ -~]){NOT_SPACE}{WS}*+", " "))
    s = F.regexp_replace(s, "([a-z])\\1\\1\\1*+", "$1")
    s = F.regexp_replace(s, f"({NONWORD})\\1+", "$1")
    s = F.regexp_replace(s, f"{NONWORD}+?\\.", ".")
    s = F.regexp_replace(s, f"([.?!,])(?={WORD})", "$1 ")
    s = F.regexp_replace(s, " ([?.!,;:\"](?: |$))", "$1")  # no other whitespace is left
    return s


def words(col: Column | str) -> Column:
    """Array of tokens (maximal letter/digit runs) in text order."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN), 0)


def ngram_array(word_array: Column, n: int) -> Column:
    """Array of the space-joined n-grams of ``word_array`` in order.

    Texts with fewer than ``n`` words give an empty array.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        return word_array
    size = F.size(word_array)
    grams = F.transform(
        F.sequence(F.lit(1), size - F.lit(n - 1)),
        lambda i: F.array_join(F.slice(word_array, i, n), " "),
    )
    return F.when(size >= F.lit(n), grams).otherwise(F.array().cast("array<string>"))


def ngram_word_array(word_array: Column, n: int) -> Column:
    """Array of the n-word slices (arrays) of ``word_array``, for n-gram filters."""
    size = F.size(word_array)
    slices = F.transform(
        F.sequence(F.lit(1), size - F.lit(n - 1)),
        lambda i: F.slice(word_array, i, n),
    )
    return F.when(size >= F.lit(n), slices).otherwise(F.array().cast("array<array<string>>"))
