"""Indel similarity and the comparison of names, as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import fixed
from weftline.functions.fields import name_tokens


def _lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a row of the table for each
    character of a, folded over those of b."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.concat(F.array(F.lit("")), y), lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        grow = lambda made, j: F.concat(made, F.array(F.when(F.get(y, j - 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(made, j - 1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), grow)

    return F.element_at(F.aggregate(x, zero, step), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (|a| + |b|), from 0 to 100; two empty strings are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 100.0).otherwise(F.lit(200.0) * _lcs(a, b) / total)


def sorted_tokens(key: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(key, r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of a, all of
    them moved on at once by each character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_of_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio() of many pairs of texts, neither empty: for joins, where the table of
    a longest common subsequence would be built pair by pair in arrays."""
    return pd.Series([200.0 * common(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype=float)


def _compared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Whether names are compatible where that is plain, else null; and both keys."""
    ta, tb = name_tokens(a), name_tokens(b)
    ka, kb = F.array_join(ta, " "), F.array_join(tb, " ")
    fa, fb = F.try_element_at(ta, F.lit(1)), F.try_element_at(tb, F.lit(1))
    initial = (F.try_element_at(ta, F.lit(-1)) == F.try_element_at(tb, F.lit(-1))) & (F.left(fa, F.lit(1)) == F.left(fb, F.lit(1))) & ((F.length(fa) == 1) | (F.length(fb) == 1))
    longest = F.lit(200) * F.least(F.length(ka), F.length(kb)) / (F.length(ka) + F.length(kb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), False).when(ka == kb, True).when(initial, True).when(longest < fixed.NAME_SIMILARITY, False), ka, kb


def names_compatible(a: Column, b: Column) -> Column:
    """Equal keys; or one surname and first names of which one is the other's initial;
    or keys that are similar enough. Empty keys agree with nothing. The costly
    comparison stands behind the cheap ones, and behind a bound by length."""
    plain, ka, kb = _compared(a, b)
    return F.coalesce(plain, token_sort_ratio(ka, kb) >= fixed.NAME_SIMILARITY)


def compatible_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of pairs whose names are compatible, as names_compatible() says."""
    plain, ka, kb = _compared(F.col(a), F.col(b))
    told = pairs.withColumns({"_plain": plain, "_ka": sorted_tokens(ka), "_kb": sorted_tokens(kb)})
    sure = told.where("_plain")
    open_ = told.where("_plain is null").where(indel_of_texts("_ka", "_kb") >= fixed.NAME_SIMILARITY)
    return sure.unionByName(open_).drop("_plain", "_ka", "_kb")
