"""The report of each company: its year, its codes and buyers, its rivals, what it missed, what is to be expected, and who buys.

All take tenders (one row per tender_id) and bidders (one row per tender_id and company_name) and answer for every company at
once.  A company's segment is the set of its five most frequent codes; whatever depends on the segment alone is worked out
once per distinct segment.  Companies without a name, tenders without a code or a date and bids without a tender are left
out of the sections that need them; ties go by value, then by name.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidscope.operators.ranks import with_place
from bidscope.workspace import discard, materialize

_CODES = 5  # codes that make a segment
_YEAR = 365
_MARK = "\x01"  # stands in no code and no name


def _row_count():
    return F.count(F.lit(1))


def _bids(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Bids with their tender's code, buyer and date, and the value if it was won."""
    t = tenders.select("tender_id", F.substring("cpv_code", 1, 8).alias("code"), "procuring_entity", "publication_date", "actual_value_mkd")
    won = F.coalesce("is_winner", F.lit(False))
    joined = bidders.filter(F.col("company_name").isNotNull()).select("tender_id", "company_name", won.alias("won")).join(t, "tender_id")
    return joined.withColumn("won_value", F.when(F.col("won"), F.coalesce("actual_value_mkd", F.lit(0.0))).otherwise(0.0))


def _since(as_of: date, days: int = _YEAR):
    return F.col("publication_date") >= F.lit(as_of - timedelta(days=days))


def report_year(tenders: DataFrame, bidders: DataFrame, as_of: date, *, days: int = _YEAR) -> DataFrame:
    """(company_name, participations, wins, win_rate, won_value) over the days before ``as_of``."""
    per = _bids(tenders, bidders).filter(_since(as_of, days)).groupBy("company_name").agg(_row_count().alias("participations"), F.count_if("won").alias("wins"), F.sum("won_value").alias("won_value"))
    return per.select("company_name", "participations", "wins", F.round(F.col("wins") * 100.0 / F.col("participations"), 1).alias("win_rate"), "won_value")


def _most_frequent(bids: DataFrame, key: str, k: int) -> DataFrame:
    per = bids.filter(F.col(key).isNotNull()).groupBy("company_name", key).agg(_row_count().alias("bids"), F.count_if("won").alias("wins"), F.sum("won_value").alias("won_value"))
    place = F.row_number().over(Window.partitionBy("company_name").orderBy(F.desc("bids"), F.desc("won_value"), key))
    return per.withColumn("place", place).filter(F.col("place") <= k)


def report_codes(tenders: DataFrame, bidders: DataFrame, *, k: int = 3) -> DataFrame:
    """(company_name, code, bids, wins, won_value, place): the codes of most bids, by all years."""
    return _most_frequent(_bids(tenders, bidders), "code", k)


def report_buyers(tenders: DataFrame, bidders: DataFrame, *, k: int = 3) -> DataFrame:
    """(company_name, procuring_entity, bids, wins, won_value, place): the buyers of most bids, by all years."""
    return _most_frequent(_bids(tenders, bidders), "procuring_entity", k)


def segments(tenders: DataFrame, bidders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company_name, segment) and (segment, code): companies with equal codes share a segment."""
    top = _most_frequent(_bids(tenders, bidders), "code", _CODES)
    named = F.array_join(F.sort_array(F.collect_list("code")), _MARK)  # five codes at most
    own = materialize(top.groupBy("company_name").agg(named.alias("segment")), "report-segments")
    codes = own.select("segment").distinct().select("segment", F.explode(F.split("segment", _MARK)).alias("code"))
    return own, materialize(codes, "report-codes")


def top_sums(sets: DataFrame, lists: DataFrame, k: int, *, least: int = 1, first: int = 64) -> DataFrame:
    """(set_id, item, n, value, place): of each set (set_id, key) the ``k`` items whose counts, summed over its keys, are greatest.

    ``lists`` is (key, item, n, value); sums of n under ``least`` don't count, ties go by the sum of value, then by item.  No
    set meets the whole list of a key: candidates are the first items of each of its keys, scored in full.  An item that is
    in none of these heads has at most the sum of the heads' last counts.  A set whose k-th candidate beats that is
    settled; the others go on with heads eight times as long, to the whole lists if need be, so the result is exact.
    """
    lists = materialize(lists.filter("n > 0"), "sum-lists")
    rest = materialize(sets.select("set_id", "key").distinct(), "sum-sets")
    found = None
    size = max(first, k + 1)
    while found is None or not rest.isEmpty():
        order = Window.partitionBy("key").orderBy(F.desc("n"), F.desc("value"), "item")
        heads = materialize(lists.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= size), "sum-heads")
        last = heads.filter(F.col("at") == size).select("key", F.col("n").alias("last"))
        bounds = rest.join(last, "key", "left").groupBy("set_id").agg(F.coalesce(F.sum("last"), F.lit(0)).alias("bound"))
        candidates = rest.join(heads.select("key", "item"), "key").select("set_id", "item").distinct()
        scored = candidates.join(rest, "set_id").join(lists, ["key", "item"]).groupBy("set_id", "item").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).filter(F.col("n") >= least)
        place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("n"), F.desc("value"), "item"))
        best = materialize(scored.withColumn("place", place).filter(F.col("place") <= k), "sum-best")
        reach = best.filter(F.col("place") == k).select("set_id", F.col("n").alias("reach"))
        is_open = F.col("bound") >= F.greatest(F.coalesce("reach", F.lit(0)), F.lit(least))
        still = materialize(bounds.join(reach, "set_id", "left").filter(is_open).select("set_id"), "sum-open")
        settled = best.join(still, "set_id", "left_anti")
        found = settled if found is None else found.unionByName(settled)
        discard(heads)
        rest = materialize(rest.join(still, "set_id", "left_semi"), "sum-sets")
        size *= 8
    return found


def _year_lists(tenders: DataFrame, bidders: DataFrame, as_of: date, *keys: str) -> DataFrame:
    """(*keys, item, n, value): wins of each company in the year, by code and whatever else."""
    won = _bids(tenders, bidders).filter(_since(as_of) & F.col("won") & F.col("code").isNotNull())
    return won.groupBy(*keys, F.col("company_name").alias("item")).agg(_row_count().alias("n"), F.sum("won_value").alias("value"))


def report_rivals(tenders: DataFrame, bidders: DataFrame, as_of: date, *, k: int = 5, least: int = 2) -> DataFrame:
    """(company_name, rival, wins, won_value, place): who else won most in the company's segment in the year, twice at least."""
    own, codes = segments(tenders, bidders)
    lists = _year_lists(tenders, bidders, as_of, "code").withColumnRenamed("code", "key")
    best = top_sums(codes.select(F.col("segment").alias("set_id"), F.col("code").alias("key")), lists, k + 1, least=least)  # one may be the company itself
    others = own.join(best.withColumnRenamed("set_id", "segment"), "segment").filter(F.col("item") != F.col("company_name"))
    place = F.row_number().over(Window.partitionBy("company_name").orderBy("place"))
    return others.withColumn("p", place).filter(F.col("p") <= k).select("company_name", F.col("item").alias("rival"), F.col("n").alias("wins"), F.col("value").alias("won_value"), F.col("p").alias("place"))


def report_missed(tenders: DataFrame, bidders: DataFrame, as_of: date, *, days: int = 90, k: int = 10) -> DataFrame:
    """(company_name, tender_id, code, closing_date, value, place): the last tenders of the segment that the company didn't bid on.

    Tenders of a code are numbered by closing date, the last first.  Between two of its own bids a company missed the
    numbers that lie between, so only gaps with fewer than ``k`` missed before them are read, ``k`` numbers of each at
    most.  The company's bids are neither gathered nor compared with all tenders of the code.
    """
    own, codes = segments(tenders, bidders)
    mine = own.join(codes, "segment").select("company_name", "code")
    value = F.coalesce(F.nullif("actual_value_mkd", F.lit(0.0)), "estimated_value_mkd", F.lit(0.0))
    recent = tenders.filter(_since(as_of, days) & F.col("status").isin("awarded", "closed") & F.col("cpv_code").isNotNull())
    recent = recent.select("tender_id", F.substring("cpv_code", 1, 8).alias("code"), "closing_date", value.alias("value"))
    numbered = materialize(with_place(recent, [F.col("code"), F.col("closing_date").desc_nulls_last(), F.col("tender_id")], "at"), "report-recent")
    starts = numbered.groupBy("code").agg((F.min("at") - 1).alias("before"))
    numbered = materialize(numbered.join(materialize(starts, "report-starts"), "code").select("tender_id", "code", "closing_date", "value", (F.col("at") - F.col("before")).alias("at")), "report-numbered")

    bid = bidders.select("tender_id", "company_name").distinct().join(numbered.select("tender_id", "code", "at"), "tender_id").join(mine, ["company_name", "code"])
    bid = materialize(with_place(bid.select("company_name", "code", "at"), [F.col("company_name"), F.col("code"), F.col("at")], "row"), "report-bids")
    firsts = materialize(bid.groupBy("company_name", "code").agg(F.min("row").alias("first_row"), F.min("at").alias("first_at")), "report-firsts")
    following = bid.select("company_name", "code", (F.col("row") - 1).alias("row"), F.col("at").alias("next_at"))
    missed_before = F.col("at") - (F.col("row") - F.col("first_row") + 1)
    inner = bid.join(firsts, ["company_name", "code"]).filter(missed_before < k).join(following, ["company_name", "code", "row"], "left").select("company_name", "code", (F.col("at") + 1).alias("low"), F.col("next_at").alias("high"))
    outer = mine.join(firsts, ["company_name", "code"], "left").select("company_name", "code", F.lit(1).alias("low"), F.col("first_at").alias("high"))
    high = F.least(F.col("high") - 1, F.col("low") + k - 1)  # where no bid follows, ``high`` is null and least() passes it over
    gaps = inner.unionByName(outer).withColumn("high", high).filter("low <= high")
    open_numbers = gaps.select("company_name", "code", F.explode(F.sequence("low", "high")).alias("at"))
    place = F.row_number().over(Window.partitionBy("company_name").orderBy(F.col("closing_date").desc_nulls_last(), "tender_id"))
    return open_numbers.join(numbered, ["code", "at"]).withColumn("place", place).filter(F.col("place") <= k).select("company_name", "tender_id", "code", "closing_date", "value", "place")


def report_expected(tenders: DataFrame, bidders: DataFrame, as_of: date) -> DataFrame:
    """(company_name, low, mid, high, confidence): tenders to expect in a month: the mean of the months that had any in the year, and
    half less or more.  Six months make it medium, fewer low; a segment without tenders has zeros."""
    own, codes = segments(tenders, bidders)
    month = F.year("publication_date") * 12 + F.month("publication_date")
    first = as_of - timedelta(days=_YEAR)
    bit = F.pow(F.lit(2), month - F.lit(first.year * 12 + first.month)).cast("long")  # thirteen months at most
    is_recent = _since(as_of) & (F.col("publication_date") <= F.lit(as_of)) & F.col("cpv_code").isNotNull()
    per_code = materialize(tenders.filter(is_recent).groupBy(F.substring("cpv_code", 1, 8).alias("code")).agg(_row_count().alias("n"), F.bit_or(bit).alias("months")), "report-months")
    per = codes.join(per_code, "code", "left").groupBy("segment").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bit_count(F.coalesce(F.bit_or("months"), F.lit(0).cast("long"))).alias("months"))
    mean = F.coalesce(F.try_divide("n", "months"), F.lit(0.0))
    volume = materialize(per.select("segment", F.floor(mean * 0.5).alias("low"), F.floor(mean).alias("mid"), F.floor(mean * 1.5).alias("high"), F.when(F.col("months") >= 6, "medium").otherwise("low").alias("confidence")), "report-volume")
    return own.join(volume, "segment").drop("segment")


def report_buyer_map(tenders: DataFrame, bidders: DataFrame, as_of: date, *, k: int = 10) -> DataFrame:
    """(company_name, procuring_entity, tenders, value, top_winner, place): the segment's buyers of most tenders in the year, each
    with the company that won most there."""
    own, codes = segments(tenders, bidders)
    t = tenders.filter(_since(as_of) & F.col("cpv_code").isNotNull() & F.col("procuring_entity").isNotNull())
    lists = t.groupBy(F.substring("cpv_code", 1, 8).alias("key"), F.col("procuring_entity").alias("item")).agg(_row_count().alias("n"), F.coalesce(F.sum("actual_value_mkd"), F.lit(0.0)).alias("value"))
    buyers = top_sums(codes.select(F.col("segment").alias("set_id"), F.col("code").alias("key")), lists, k).withColumnRenamed("set_id", "segment")
    both = lambda a, b: F.concat_ws(_MARK, a, b)
    at_buyer = buyers.join(codes, "segment").select(both("segment", "item").alias("set_id"), both("code", "item").alias("key"))
    wins = _year_lists(tenders, bidders, as_of, "code", "procuring_entity").filter(F.col("procuring_entity").isNotNull())
    winners = top_sums(at_buyer, wins.select(both("code", "procuring_entity").alias("key"), "item", "n", "value"), 1)
    named = buyers.withColumn("set_id", both("segment", "item")).join(winners.select("set_id", F.col("item").alias("top_winner")), "set_id", "left")
    named = materialize(named.select("segment", F.col("item").alias("procuring_entity"), F.col("n").alias("tenders"), "value", "top_winner", "place"), "report-map")
    return own.join(named, "segment").drop("segment")
