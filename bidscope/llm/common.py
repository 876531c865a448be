"""Helpers that several corpus operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.workspace import materialize

#: Characters that separate words: space and the ASCII controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: a null id is larger than all others.
NULL_ID = (1 << 63) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a text without any."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def row_hash(*names: str) -> Column:
    """SHA-256 of some columns together.  A null text is an empty one; any other null differs from all values."""
    parts = [text_or_empty(n) if n == "text" else F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")) for n in names]
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]  # so that no two lists of values read alike
    return F.sha2(F.encode(F.concat(*sized), "UTF-8"), 256)


def range_index(value: Column, splitters: list[int]) -> Column:
    """Number of sorted ``splitters`` below ``value``, found in two steps of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    as_array = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    if len(groups) == 1:
        return F.size(F.filter(as_array(splitters), lambda s: s < value))
    last = as_array([g[-1] for g in groups])
    below = F.size(F.filter(last, lambda s: s < value))
    inner = F.get(F.array(*[as_array(g) for g in groups]), below)
    return below * step + F.coalesce(F.size(F.filter(inner, lambda s: s < value)), F.lit(0)) * (below < len(groups)).cast("int")


def partitions_for(rows: int, rows_each: int, most: int = 1 << 20) -> int:
    return int(min(most, max(1, math.ceil(rows / rows_each))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def attach(df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns where null equals null, keeping the columns of ``on`` once."""
    right = other.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in other.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return df.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def number_rows(df: DataFrame, keys: list[str], number: str, name: str, *, rows_each: int = 50_000) -> DataFrame:
    """Add ``name``: the row's place, from 1, among those equal in ``keys`` (nulls too), by ``number``, which tells rows apart.

    Keys that many rows share are numbered in parts, dealt by the hash of ``number``, whose sizes are summed first.
    """
    part, parts, own, before = (free_name(df, c) for c in ("__part", "__parts", "__own", "__before"))
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_each).cast("long").alias(parts))
    cut = attach(df, materialize(counts, "number-parts"), keys, "inner").withColumn(part, F.pmod(F.xxhash64(number), F.col(parts))).drop(parts)
    cut = materialize(cut, "number-rows")
    up_to = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = cut.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(own)).select(*keys, part, F.coalesce(F.sum(own).over(up_to), F.lit(0)).alias(before))
    numbered = cut.withColumn(own, F.row_number().over(Window.partitionBy(*keys, part).orderBy(number)))
    return attach(numbered, materialize(sizes, "number-offsets"), [*keys, part], "inner").withColumn(name, F.col(own) + F.col(before)).drop(own, before, part)
