"""Words and word shingles as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words: everything but letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"
SHINGLE = 5


def words(text: Column) -> Column:
    """Lower-case words of a text; none for null, empty and wordless texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _starts(words_of: Column) -> Column:
    """Where shingles begin: a text of one to four words has one shingle of them all."""
    return F.when(F.size(words_of) > 0, F.sequence(F.lit(0), F.greatest(F.size(words_of) - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles(words_of: Column) -> Column:
    """All shingles as texts, words joined by spaces; repeated ones stay."""
    return F.transform(_starts(words_of), lambda i: F.array_join(F.slice(words_of, i + 1, SHINGLE), " "))


def shingle_hashes(words_of: Column) -> Column:
    """xxhash64 of each shingle's words, in the order of `shingles`; words that a short text lacks count as null."""
    return F.transform(_starts(words_of), lambda i: F.xxhash64(*(F.get(words_of, i + k) for k in range(SHINGLE))))
