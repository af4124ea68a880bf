"""Words of a text, as every operator of this package reads them.

A-Z become a-z; a word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters.
Null and empty texts have no words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")  # the same in texts not lowered

# Bytes of a word stay (A-Z lowered), all others become blanks. Bytes from 128 on belong to
# non-ASCII characters, so this may work on UTF-8 without decoding it.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words in order, as UTF-8."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word, in characters of the original text."""
    return [m.span() for m in _WORD.finditer(text)]


def lowered(text: Column) -> Column:
    """A-Z become a-z, nothing else changes; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words as an array column."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD_PATTERN), F.lit(0))
