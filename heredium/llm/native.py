"""Words and shingles as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES, NOT_ALNUM = "[ \t-\r]+", r"[^\p{L}\p{N}]+"
SIZE = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column, separators: str = SPACES) -> Column:
    return F.filter(F.split(text, separators), lambda w: w != "")


def shingle_hashes(w: Column, size: int = SIZE, whole: bool = True) -> Column:
    """64-bit hash of each run of ``size`` words; of all words where there are fewer (``whole``) or none."""
    none = F.array().cast("array<bigint>")

    def of(v: Column) -> Column:
        n = F.size(v)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(v, i, size)))
        return F.when(n >= (1 if whole else size), runs).otherwise(none)

    return let(w, of)


def shingle_texts(w: Column, size: int = SIZE) -> Column:
    """The distinct runs of ``size`` words, joined by spaces; none where there are fewer words."""
    def of(v: Column) -> Column:
        n = F.size(v)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(v, i, size), " "))
        return F.when(n >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(w, of)
