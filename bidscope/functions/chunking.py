"""Texts cut into chunks by sentences, paragraphs, a fixed number of words, or paragraphs packed up to a size.

A text's units stay in one row: their token counts go through a small vectorised function that says where chunks begin, and
the chunks are slices of the units, so nothing is shuffled and a long text is no group of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a chunk, words carried over, characters that make a token in Cyrillic and other text.
SIZE, OVERLAP, PER_TOKEN = 512, 64, {"cyrillic": 5, "other": 4}
#: How many words of the fixed mode make a token's size, and what ends sentences and paragraphs.
FIXED_WORDS = 4
SENTENCE_END, PARAGRAPH_END = r"[.!?]+[ \t\n\x0B\f\r]+", r"\n[ \t\n\x0B\f\r]*\n+"
_GAP = r"[ \t\n\x0B\f\r]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_GAP}|{_GAP}$", "")


def split_units(text: Column, pattern: str) -> Column:
    """Parts between the matches of a pattern, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), stripped), lambda u: u != "")


def token_count(text: Column) -> Column:
    """About the tokens of a text: characters by five with Cyrillic letters in it, else by four, 1 at least; 0 if empty."""
    each = F.when(F.regexp_like(text, F.lit(r"[Ѐ-ӿ]")), PER_TOKEN["cyrillic"]).otherwise(PER_TOKEN["other"])
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / each))).cast("int")


def _runs(size: int):
    """(tokens, groups) -> [(first, end)]: units of one group taken together while their tokens fit, one at least."""

    @F.pandas_udf("array<struct<first:int,end:int>>")
    def pack(tokens: pd.Series, groups: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(tokens, groups, strict=True):
            sums, ends = np.cumsum(np.asarray(t, np.int64)), np.r_[np.flatnonzero(np.diff(np.asarray(g))) + 1, len(g)]
            found, at = [], 0
            while at < len(sums):
                fits = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + size, "right"))
                end = min(max(fits, at + 1), int(ends[np.searchsorted(ends, at, "right")]))
                found.append({"first": at, "end": end})
                at = end
            out.append(found)
        return pd.Series(out)

    return pack


def _sums_before():
    """Sums of the numbers before each of an array."""

    @F.pandas_udf("array<long>")
    def sums(lengths: pd.Series) -> pd.Series:
        return pd.Series([np.r_[0, np.cumsum(np.asarray(n, np.int64))[:-1]] if len(n) else np.zeros(0, np.int64) for n in lengths])

    return sums


def chunks(docs: DataFrame, mode: str = "semantic", *, key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, start_char, end_char, tokens, text).

    * sentence: sentences in order while their tokens fit;
    * paragraph: one each;
    * fixed: ``FIXED_WORDS`` x ``size`` words each;
    * semantic: paragraphs while they fit, one that is larger by its sentences; each chunk begins with the last
      ``overlap`` words of the one before.

    ``start_char`` and ``end_char`` count the characters of the chunks before it and of its own, without what is carried
    over.  Null and blank texts have no chunks; repeated rows give repeated chunks; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key, text.alias("t"))
    if mode == "sentence":
        units = F.transform(split_units(F.col("t"), SENTENCE_END), lambda s: F.struct(s.alias("u"), F.lit(0).alias("g"), F.lit(" ").alias("by")))
    elif mode == "paragraph":
        units = F.transform(split_units(F.col("t"), PARAGRAPH_END), lambda p, i: F.struct(p.alias("u"), i.alias("g"), F.lit("").alias("by")))
    elif mode == "fixed":
        units = F.transform(split_units(F.col("t"), _GAP), lambda w, i: F.struct(w.alias("u"), F.floor(i / (FIXED_WORDS * size)).cast("int").alias("g"), F.lit(" ").alias("by")))
    elif mode == "semantic":
        one = lambda p, i: F.array(F.struct(p.alias("u"), F.lit(-1).alias("g"), F.lit("\n\n").alias("by")))
        many = lambda p, i: F.transform(split_units(p, SENTENCE_END), lambda s: F.struct(s.alias("u"), i.alias("g"), F.lit(" ").alias("by")))
        units = F.flatten(F.transform(split_units(F.col("t"), PARAGRAPH_END), lambda p, i: F.when(token_count(p) <= size, one(p, i)).otherwise(many(p, i))))
    else:
        raise ValueError(f"no mode {mode}")
    rows = rows.select(key, units.alias("units"))
    # One group is taken whole in the modes whose groups are chunks already.
    tokens = F.transform("units", lambda u: F.lit(0) if mode in ("paragraph", "fixed") else token_count(u["u"]))
    rows = rows.select(key, "units", _runs(size)(tokens, F.transform("units", lambda u: u["g"])).alias("runs"))
    own = lambda r: F.slice("units", r["first"] + 1, r["end"] - r["first"])
    joined = F.transform("runs", lambda r: F.array_join(F.transform(own(r), lambda u: u["u"]), " ") if mode != "semantic" else F.when(F.get(F.col("units"), r["first"])["by"] == " ", F.array_join(F.transform(own(r), lambda u: u["u"]), " ")).otherwise(F.array_join(F.transform(own(r), lambda u: u["u"]), "\n\n")))
    rows = rows.select(key, joined.alias("texts"))
    rows = rows.select(key, "texts", _sums_before()(F.transform("texts", F.length)).alias("starts"))
    if mode == "semantic" and overlap:
        last = lambda t: F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(stripped(t), _GAP)), 1, overlap)), 1, overlap), " ")
        shown = F.transform("texts", lambda t, i: F.when(i > 0, F.concat(last(F.get(F.col("texts"), i - 1)), F.lit(" "), t)).otherwise(t))
    else:
        shown = F.col("texts")
    each = F.transform(shown, lambda s, i: F.struct(s.alias("text"), F.get("starts", i).alias("start_char"), (F.get("starts", i) + F.length(F.get(F.col("texts"), i))).alias("end_char")))
    out = rows.select(key, F.posexplode(each).alias("chunk", "c"))
    return out.select(key, "chunk", "c.start_char", "c.end_char", token_count(F.col("c.text")).alias("tokens"), "c.text")
