"""Columns over token sequences and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n elements; none if there are fewer."""
    # sequence(1, 0) would count down, so short arrays are cut off first.
    return F.when(F.size(tokens) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n)))


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of n code points, spaces included."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(ngrams(chars, n), lambda g: F.array_join(g, ""))


def distinct_share(grams: Column) -> Column:
    """Distinct n-grams over all; 0 if there are none."""
    return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(grams)) / F.size(grams))


def repetition(grams: Column) -> Column:
    """Share of n-grams beyond the first of each kind; 0 if there are none."""
    return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise((F.size(grams) - F.size(F.array_distinct(grams))) / F.size(grams))


def padded(ids: Column, length: int, pad: int, truncate: bool = True) -> Column:
    """Right-padded to ``length``; longer sequences are cut, or left long."""
    cut = F.slice(ids, 1, length) if truncate else ids
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs and targets of next-token prediction."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, 1, n), F.slice(ids, 2, n)


def without_ids(ids: Column, special: list[int]) -> Column:
    """Order and repeats of the others are kept."""
    return F.filter(ids, lambda i: ~i.isin(special))


def framed(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    parts = [F.array(F.lit(bos))] if bos is not None else []
    parts.append(ids)
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def paired(a: Column, b: Column) -> Column:
    """Elements side by side, as far as the shorter array goes."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.element_at(a, i).cast("int").alias("a"), F.element_at(b, i).cast("int").alias("b"))))
