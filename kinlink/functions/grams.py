"""Character and word n-grams as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def char_wb(text: Column, shortest: int, longest: int) -> Column:
    """Character n-grams inside words that are padded with a blank at either end. A padded word not longer than n gives itself
    once, for the smallest such n."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), " "), lambda w: w != "")

    def of(padded: Column) -> Column:
        size = F.length(padded)

        def windows(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

        none = F.array().cast("array<string>")
        return F.concat(windows(shortest), *(F.when(size >= n, windows(n)).otherwise(none) for n in range(shortest + 1, longest + 1)))

    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: of(p)))


def word_ngrams(text: Column, shortest: int = 1, longest: int = 2) -> Column:
    """Word n-grams over words of two letters or more, joined by a blank. Words are taken by their place: slice() copies the whole
    array at each call, so time would grow with the square of a text's words."""

    def of(words: Column) -> Column:
        def runs(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", *(F.get(words, i + (j - 1)) for j in range(n))))

        none = F.array().cast("array<string>")
        return F.concat(*(words if n == 1 else F.when(F.size(words) >= n, runs(n)).otherwise(none) for n in range(shortest, longest + 1)))

    return bind(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0)), of)
