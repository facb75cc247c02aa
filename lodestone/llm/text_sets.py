"""Word shingles as 64-bit hashes, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SHINGLE_WORDS = 5


def bind(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Lower-case words between white space."""
    low = F.lower(text)
    # Text with single spaces alone is split at these, without a pattern.
    other = [text == "", text.startswith(" "), text.endswith(" "), *(text.contains(c) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r"))]
    return F.when(reduce(or_, other), F.array_remove(F.split(low, SPACE), "")).otherwise(F.split(low, " "))


def shingles_of(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of all windows of ``size`` words, in order; of fewer words one hash of all, of none no hash."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    many = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    one = F.array(F.xxhash64(F.array_join(words, " "), F.size(words)))
    return F.when(F.size(words) >= size, many).when(F.size(words) > 0, one).otherwise(F.array().cast(ArrayType(LongType(), False)))


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """``shingles_of`` the words of a text."""
    return bind(words_of(text), lambda w: shingles_of(w, size))
