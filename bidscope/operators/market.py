"""Market, price, competitor, buyer and supplier statistics over tenders, bids and items."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.operators.detectors import AWARDED
from bidscope.operators.ranks import with_place, with_rank
from bidscope.workspace import materialize


def row_count() -> Column:
    return F.count(F.lit(1))


def money(x: Column) -> Column:
    return F.round(x, 4)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)


def awarded(tenders: DataFrame) -> DataFrame:
    return tenders.filter(F.col("status").isin(*AWARDED))


def won(tenders: DataFrame) -> DataFrame:
    return awarded(tenders).filter("winner is not null")


#: Upper bounds of the value bands.
BANDS = ((500_000, "under 500k"), (1_000_000, "500k-1m"), (2_000_000, "1m-2m"), (5_000_000, "2m-5m"), (10_000_000, "5m-10m"))


def value_band(value: Column) -> Column:
    out = F.lit("10m and more")
    for top, name in reversed(BANDS):
        out = F.when(value < top, name).otherwise(out)
    return F.when(value.isNull(), "unknown").otherwise(out)


def market_totals(tenders: DataFrame) -> DataFrame:
    return tenders.agg(
        row_count().alias("tenders"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status").isin(*AWARDED)).alias("awarded"), F.sum("estimated_value_mkd").alias("estimated"), F.sum("actual_value_mkd").alias("actual"),
        money(F.avg("num_bidders")).alias("mean_bidders"), F.count_distinct("procuring_entity").alias("buyers"), F.count_distinct("winner").alias("winners"),
    )


def by_value_band(tenders: DataFrame) -> DataFrame:
    return tenders.groupBy(value_band(F.col("estimated_value_mkd")).alias("band")).agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"), money(F.avg("num_bidders")).alias("mean_bidders"))


def monthly_trend(tenders: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    recent = tenders.filter((F.col("publication_date") >= F.add_months(F.lit(as_of), -months)) & (F.col("publication_date") <= F.lit(as_of)))
    return recent.groupBy(F.date_format("publication_date", "yyyy-MM").alias("month")).agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"), F.count_if(F.col("status").isin(*AWARDED)).alias("awarded"))


def top_groups(tenders: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with most tenders; of equals the first by name."""
    return tenders.filter(F.col(key).isNotNull()).groupBy(key).agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"), money(F.avg("num_bidders")).alias("mean_bidders")).orderBy(F.desc("tenders"), key).limit(k)


def competitor_analysis(bidders: DataFrame) -> DataFrame:
    """Each company's win rate against that of the market."""
    per = bidders.groupBy("company_name").agg(row_count().alias("bids"), F.count_if("is_winner").alias("wins"), F.sum(F.when(F.col("is_winner"), F.col("bid_amount_mkd"))).alias("won_value"), money(F.avg("bid_amount_mkd")).alias("mean_bid"))
    market = per.agg(F.sum("bids").alias("all_bids"), F.sum("wins").alias("all_wins"))
    return per.crossJoin(market).select("company_name", "bids", "wins", "won_value", "mean_bid", share(F.col("wins"), F.col("bids")).alias("win_rate"), share(F.col("all_wins"), F.col("all_bids")).alias("market_win_rate"))  # market: one row


def category_trends(tenders: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Tenders per category in the period and the one before, with growth."""
    age = F.datediff(F.lit(as_of), "publication_date")
    period = F.when(age.between(0, days - 1), "now").when(age.between(days, 2 * days - 1), "before")
    counted = tenders.withColumn("period", period).filter("period is not null").groupBy("category").agg(F.count_if(F.col("period") == "now").alias("now"), F.count_if(F.col("period") == "before").alias("before"), F.sum(F.when(F.col("period") == "now", F.col("estimated_value_mkd"))).alias("value_now"))
    return counted.withColumn("growth", share(F.col("now") - F.col("before"), F.col("before")))


def top_per_group(tenders: DataFrame, group: str, key: str, k: int = 5) -> DataFrame:
    """The k keys with most awards in each group."""
    counts = won(tenders).filter(F.col(group).isNotNull()).groupBy(group, key).agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("wins"), F.desc("value"), key))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def supplier_strength(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Points for win rate, wins, value, diversity of categories and buyers; a tier; and the place among all."""
    joined = bidders.join(tenders.select("tender_id", "category", "procuring_entity"), "tender_id")
    per = joined.groupBy("company_name").agg(
        row_count().alias("bids"), F.count_if("is_winner").alias("wins"), F.coalesce(F.sum(F.when(F.col("is_winner"), F.col("bid_amount_mkd"))), F.lit(0.0)).alias("value"),
        F.count_distinct(F.when(F.col("is_winner"), F.col("category"))).alias("categories"), F.count_distinct(F.when(F.col("is_winner"), F.col("procuring_entity"))).alias("buyers"),
    )
    rate = F.col("wins") * 100.0 / F.col("bids")
    points = F.least(F.lit(30.0), rate * 1.5) + F.least(F.lit(25.0), F.col("wins") * 2.0) + F.least(F.lit(20.0), F.col("value") / 1e6) + F.least(F.lit(15.0), F.col("categories") * 3.0) + F.least(F.lit(10.0), F.col("buyers") * 2.0)
    scored = per.withColumn("strength", F.round(points, 4))
    tier = F.when(F.col("strength") >= 70, "strong").when(F.col("strength") >= 40, "medium").otherwise("weak")
    return with_rank(scored.withColumn("tier", tier), "strength")


def price_history(tenders: DataFrame, cpv_prefix: str, unit: str = "month") -> DataFrame:
    own = won(tenders).filter(F.col("cpv_code").startswith(cpv_prefix) & (F.col("estimated_value_mkd") > 0) & F.col("actual_value_mkd").isNotNull())
    discount = (F.col("estimated_value_mkd") - F.col("actual_value_mkd")) * 100.0 / F.col("estimated_value_mkd")
    return own.groupBy(F.date_trunc(unit, "publication_date").cast("date").alias("period")).agg(row_count().alias("tenders"), money(F.avg("estimated_value_mkd")).alias("mean_estimate"), money(F.avg("actual_value_mkd")).alias("mean_actual"), money(F.avg(discount)).alias("mean_discount"))


def price_trend(tenders: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Per category: mean award of the later half of its awards against the earlier half."""
    own = won(tenders).filter("category is not null and actual_value_mkd is not null")
    half = F.ntile(2).over(Window.partitionBy("category").orderBy("publication_date", "tender_id"))
    halves = own.withColumn("half", half).groupBy("category").agg(F.avg(F.when(F.col("half") == 1, F.col("actual_value_mkd"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("actual_value_mkd"))).alias("b"))
    change = F.try_divide((F.col("b") - F.col("a")) * 100.0, F.col("a"))
    return halves.select("category", F.round(change, 4).alias("change"), F.when(change > threshold, "increasing").when(change < -threshold, "decreasing").when(change.isNotNull(), "stable").alias("trend"))


def bid_advice(tenders: DataFrame) -> DataFrame:
    """Per category: the winning ratio's median and spread, and what it suggests to bid per unit of estimate."""
    ratio = F.col("actual_value_mkd") / F.col("estimated_value_mkd")
    own = won(tenders).filter("estimated_value_mkd > 0 and actual_value_mkd is not null and category is not null").withColumn("ratio", ratio)
    stats = own.groupBy("category").agg(row_count().alias("n"), F.percentile("ratio", 0.5).alias("median"), F.stddev_samp("ratio").alias("sd"), F.percentile("ratio", 0.25).alias("q1"), F.percentile("ratio", 0.75).alias("q3"))
    low, high = F.greatest(F.lit(0.0), F.col("median") - F.coalesce("sd", F.lit(0.0))), F.col("median") + F.coalesce("sd", F.lit(0.0))
    return stats.select("category", "n", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3")], F.round(low, 6).alias("aggressive"), F.round(high, 6).alias("safe"))


def item_benchmarks(items: DataFrame, least: int = 2) -> DataFrame:
    return items.groupBy("name").agg(row_count().alias("n"), F.min("unit_price").alias("low"), F.round(F.avg("unit_price"), 6).alias("mean"), F.max("unit_price").alias("high")).filter(F.col("n") >= least)


def item_price_intelligence(items: DataFrame, least: int = 5) -> DataFrame:
    """Quartiles of an item's unit price, number of offering companies and brands, and its cheapest company."""
    own = items.filter("unit_price > 0")
    q = lambda p: F.round(F.percentile("unit_price", p), 6)
    return own.groupBy("name").agg(row_count().alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.count_distinct("company_name").alias("companies"), F.count_distinct("brand").alias("brands"), F.min(F.struct("unit_price", "company_name"))["company_name"].alias("cheapest")).filter(F.col("n") >= least)


def item_price_by_year(items: DataFrame) -> DataFrame:
    """Weighted by quantity."""
    return items.groupBy(F.year("offered_on").alias("year"), "cpv_code").agg(row_count().alias("lines"), F.sum("quantity").alias("quantity"), F.round(F.try_divide(F.sum(F.col("unit_price") * F.col("quantity")), F.sum("quantity")), 4).alias("mean_price"))


def item_bid_comparison(items: DataFrame) -> DataFrame:
    """Per tender and item the lowest offer, where several companies offer it."""
    offers = items.groupBy("tender_id", "name", "company_name").agg(F.min("unit_price").alias("price"))
    per = offers.groupBy("tender_id", "name").agg(row_count().alias("companies"), F.min(F.struct("price", "company_name")).alias("low"), F.max("price").alias("high"))
    return per.filter("companies > 1").select("tender_id", "name", "companies", F.col("low.company_name").alias("lowest"), F.col("low.price").alias("low_price"), F.col("high").alias("high_price"))


def activity_feed(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Every bid as won, lost or pending, with the discount from the estimate."""
    j = bidders.join(tenders.select("tender_id", "procuring_entity", "estimated_value_mkd", "status", "winner", "closing_date"), "tender_id")
    outcome = F.when(F.col("is_winner"), "won").when(F.col("winner").isNotNull(), "lost").otherwise("bid")
    discount = F.when(F.col("estimated_value_mkd") > 0, F.round((F.col("estimated_value_mkd") - F.col("bid_amount_mkd")) * 100.0 / F.col("estimated_value_mkd"), 4))
    return j.select("tender_id", "company_name", "closing_date", outcome.alias("outcome"), discount.alias("discount"))


def bidding_patterns(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per company: how steady its bids are against estimates, when and where it bids."""
    j = bidders.join(tenders.filter("estimated_value_mkd > 0"), "tender_id").withColumn("ratio", F.col("bid_amount_mkd") / F.col("estimated_value_mkd"))
    per = j.groupBy("company_name").agg(row_count().alias("bids"), F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("sd"), F.count_distinct("category").alias("categories"), F.count_distinct("procuring_entity").alias("buyers"), F.count_if(F.col("estimated_value_mkd") < 1e6).alias("small"), F.count_if(F.col("estimated_value_mkd") >= 1e7).alias("large"))
    steady = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("sd", "m"), F.lit(0.0)) / 2)
    return per.select("company_name", "bids", "categories", "buyers", "small", "large", F.round("m", 6).alias("mean_ratio"), F.round(steady, 6).alias("consistency"))


def head_to_head(bidders: DataFrame) -> DataFrame:
    """Every pair of companies on common tenders: wins of each, who bid lower, mean gap."""
    a = bidders.select("tender_id", F.col("company_name").alias("company_a"), F.col("bid_amount_mkd").alias("x"), F.col("is_winner").alias("a_won"))
    b = bidders.select("tender_id", F.col("company_name").alias("company_b"), F.col("bid_amount_mkd").alias("y"), F.col("is_winner").alias("b_won"))
    gap = F.try_divide(F.abs(F.col("x") - F.col("y")), F.greatest("x", "y"))
    return a.join(b, "tender_id").filter("company_a < company_b").groupBy("company_a", "company_b").agg(row_count().alias("together"), F.count_if("a_won").alias("a_wins"), F.count_if("b_won").alias("b_wins"), F.count_if(F.col("x") < F.col("y")).alias("a_lower"), F.round(F.avg(gap), 6).alias("mean_gap"))


def price_competitiveness(bidders: DataFrame) -> DataFrame:
    """Per company: distance from the tender's mean and lowest bid, times lowest and highest, mean rank."""
    w = Window.partitionBy("tender_id")
    j = bidders.filter("bid_amount_mkd > 0").withColumns({"mean": F.avg("bid_amount_mkd").over(w), "low": F.min("bid_amount_mkd").over(w), "high": F.max("bid_amount_mkd").over(w), "n": F.count(F.lit(1)).over(w)}).filter("n > 1")
    v = F.col("bid_amount_mkd")
    return j.groupBy("company_name").agg(row_count().alias("bids"), F.round(F.avg((v - F.col("mean")) * 100 / F.col("mean")), 6).alias("from_mean"), F.round(F.avg((v - F.col("low")) * 100 / F.col("low")), 6).alias("from_low"), F.count_if(v == F.col("low")).alias("lowest"), F.count_if(v == F.col("high")).alias("highest"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def market_share(tenders: DataFrame) -> DataFrame:
    """Per category each winner's share of awards and of value."""
    per = won(tenders).filter("category is not null").groupBy("category", "winner").agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value"))
    w = Window.partitionBy("category")
    return per.select("category", "winner", "wins", "value", share(F.col("wins"), F.sum("wins").over(w)).alias("wins_share"), share(F.col("value"), F.sum("value").over(w)).alias("value_share"))


def buyer_panel(tenders: DataFrame) -> DataFrame:
    """Per buyer: volumes, bidders, single bids, short deadlines."""
    days = F.datediff("closing_date", "publication_date")
    return tenders.groupBy("procuring_entity").agg(
        row_count().alias("tenders"), F.count_if(F.col("status").isin(*AWARDED)).alias("awarded"), F.sum("estimated_value_mkd").alias("estimated"), money(F.avg("num_bidders")).alias("mean_bidders"), F.round(F.percentile("num_bidders", 0.5), 4).alias("median_bidders"),
        F.count_if(F.col("num_bidders") == 1).alias("single_bids"), F.count_if(days < 7).alias("short_deadlines"), money(F.avg(days)).alias("mean_days"), F.count_distinct("winner").alias("winners"),
    )


def buyer_suspicions(tenders: DataFrame, *, top_share: float = 50.0, single_share: float = 30.0, short_share: float = 20.0, least: int = 3) -> DataFrame:
    """Buyers with a dominant winner, many single bids, or many short deadlines."""
    p = buyer_panel(tenders)
    top = won(tenders).groupBy("procuring_entity", "winner").agg(row_count().alias("wins")).groupBy("procuring_entity").agg(F.max("wins").alias("top_wins"), F.sum("wins").alias("all_wins"))
    j = p.join(top, "procuring_entity", "left")
    a = F.coalesce((F.col("top_wins") >= least) & (F.col("top_wins") * 100.0 / F.col("all_wins") > top_share), F.lit(False))
    b = F.col("single_bids") * 100.0 / F.col("tenders") > single_share
    c = F.col("short_deadlines") * 100.0 / F.col("tenders") > short_share
    return j.select("procuring_entity", a.alias("dominant_winner"), b.alias("many_single_bids"), c.alias("many_short_deadlines")).filter("dominant_winner or many_single_bids or many_short_deadlines")


def sector_statistics(tenders: DataFrame) -> DataFrame:
    """Per two-digit category code, at the grain of tenders."""
    v = F.col("actual_value_mkd")
    return awarded(tenders).filter("cpv_code is not null").groupBy(F.substring("cpv_code", 1, 2).alias("division")).agg(
        row_count().alias("tenders"), F.count_distinct("winner").alias("winners"), money(F.min(v)).alias("low"), money(F.avg(v)).alias("mean"), F.round(F.percentile(v, 0.5), 4).alias("median"), money(F.max(v)).alias("high"), money(F.avg("num_bidders")).alias("mean_bidders")
    )


def seasonality(tenders: DataFrame) -> DataFrame:
    """Per month of the year: tenders, value, and the most frequent category."""
    m = F.month("publication_date").alias("month")
    per = tenders.groupBy(m).agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"))
    modes = tenders.filter("category is not null").groupBy(m, "category").agg(row_count().alias("n")).withColumn("p", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("n"), "category"))).filter("p = 1").select("month", F.col("category").alias("top_category"))
    return per.join(modes, "month", "left")


def closing_soon(tenders: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    left = F.datediff("closing_date", F.lit(as_of))
    rows = tenders.withColumn("days_left", left).filter(F.col("days_left").between(0, days) & (F.col("status") == "open"))
    return rows.select("tender_id", "closing_date", "days_left", F.when(F.col("days_left") <= 7, "urgent").when(F.col("days_left") <= 14, "soon").otherwise("later").alias("urgency"))


def upcoming_status(tenders: DataFrame, as_of: date) -> DataFrame:
    """Open tenders past their closing date become closed."""
    status = F.when((F.col("status") == "open") & (F.col("closing_date") < F.lit(as_of)), "closed").otherwise(F.col("status"))
    return tenders.groupBy(status.alias("status")).agg(row_count().alias("tenders"))


def similar_tenders(tenders: DataFrame, k: int = 3) -> DataFrame:
    """For every award the k nearest in value of the same category and buyer, ties to the smaller id.

    Of each value the first k + 1 ids are kept; a value's neighbours are the k values before and after it, so a tender is
    compared with (2k + 1) x (k + 1) others at most.
    """
    own = won(tenders).filter("actual_value_mkd is not null and cpv_code is not null").select("tender_id", "cpv_code", "procuring_entity", F.col("actual_value_mkd").alias("value"))
    keys = ["cpv_code", "procuring_entity"]
    place = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("tender_id"))
    heads = own.withColumn("__place", place).filter(F.col("__place") <= k + 1).groupBy(*keys, "value").agg(F.collect_list("tender_id").alias("ids"))
    around = F.collect_list(F.struct("value", "ids")).over(Window.partitionBy(*keys).orderBy("value").rowsBetween(-k, k))
    heads = materialize(heads.select(*keys, "value", around.alias("around")), "value-neighbours")
    gaps = F.flatten(F.transform("around", lambda a: F.transform(a["ids"], lambda i: F.struct(F.abs(F.col("value") - a["value"]).alias("gap"), i.alias("similar_id")))))
    nearest = F.slice(F.array_sort(F.filter(gaps, lambda g: g["similar_id"] != F.col("tender_id"))), 1, k)
    each = own.join(heads, [*keys, "value"]).select("tender_id", F.posexplode(nearest).alias("place", "near"))
    return each.select("tender_id", "near.similar_id", (F.col("place") + 1).alias("place"), "near.gap")


def category_deviation(tenders: DataFrame) -> DataFrame:
    """Each award against the mean of the others of its category."""
    v, w = F.col("actual_value_mkd"), Window.partitionBy("cpv_code")
    own = won(tenders).filter("actual_value_mkd is not null and cpv_code is not null").withColumns({"s": F.sum(v).over(w), "n": F.count(F.lit(1)).over(w)}).filter("n > 1")
    mean = (F.col("s") - v) / (F.col("n") - 1)
    return own.select("tender_id", F.round(F.try_divide((v - mean) * 100, mean), 4).alias("deviation"))


def missed_opportunities(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per company: awarded tenders of its own categories that it didn't bid on: all of them, less those that it bid on."""
    t = tenders.select("tender_id", "cpv_code")
    own = bidders.filter("is_winner").select("tender_id", "company_name").join(t, "tender_id").select("company_name", "cpv_code").distinct()
    awarded = won(tenders).filter("cpv_code is not null").select("tender_id", "cpv_code", "estimated_value_mkd")
    whole = awarded.groupBy("cpv_code").agg(row_count().alias("n"), F.coalesce(F.sum("estimated_value_mkd"), F.lit(0.0)).alias("v"))
    bid_on = bidders.select("tender_id", "company_name").distinct().join(awarded, "tender_id").groupBy("company_name", "cpv_code").agg(row_count().alias("own_n"), F.coalesce(F.sum("estimated_value_mkd"), F.lit(0.0)).alias("own_v"))
    each = own.join(whole, "cpv_code").join(bid_on, ["company_name", "cpv_code"], "left").fillna(0, ["own_n"]).fillna(0.0, ["own_v"])
    per = each.groupBy("company_name").agg(F.sum(F.col("n") - F.col("own_n")).alias("missed"), F.sum(F.col("v") - F.col("own_v")).alias("missed_value"))
    return per.filter("missed > 0")


def supplier_ranking(tenders: DataFrame, bidders: DataFrame, k: int = 3) -> DataFrame:
    """Companies by won value, with their best categories and buyers as nested lists, and the market's total."""
    wins = bidders.filter("is_winner").join(tenders.select("tender_id", "category", "procuring_entity"), "tender_id")
    per = wins.groupBy("company_name").agg(row_count().alias("wins"), F.sum("bid_amount_mkd").alias("value"))

    def best(key: str) -> DataFrame:
        counts = wins.filter(F.col(key).isNotNull()).groupBy("company_name", key).agg(row_count().alias("n"))
        top = counts.withColumn("p", F.row_number().over(Window.partitionBy("company_name").orderBy(F.desc("n"), key))).filter(F.col("p") <= k)
        names = F.transform(F.sort_array(F.collect_list(F.struct("p", key))), lambda x: x[key])
        return top.groupBy("company_name").agg(F.array_join(names, ",").alias(f"top_{key}"))

    ranked = with_place(per, [F.desc("value"), F.asc("company_name")])
    ranked = ranked.crossJoin(ranked.agg(F.sum("value").alias("__all"))).withColumn("share", share(F.col("value"), F.col("__all"))).drop("__all")  # one row
    return ranked.join(best("category"), "company_name", "left").join(best("procuring_entity"), "company_name", "left")


def yearly_wins(tenders: DataFrame) -> DataFrame:
    """Wins per company and year with the change from the year before, and the running total."""
    per = won(tenders).groupBy("winner", F.year("publication_date").alias("year")).agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value"))
    w = Window.partitionBy("winner").orderBy("year")
    return per.withColumns({"change": F.col("wins") - F.lag("wins").over(w), "running": F.sum("wins").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def new_relationships(tenders: DataFrame) -> DataFrame:
    """Buyer and winner pairs with two awards at least: first and last award, days between, value."""
    per = won(tenders).groupBy("procuring_entity", "winner").agg(row_count().alias("awards"), F.min("publication_date").alias("first"), F.max("publication_date").alias("last"), F.sum("actual_value_mkd").alias("value")).filter("awards >= 2")
    return per.withColumn("days", F.datediff("last", "first"))


def keyword_search(tenders: DataFrame, terms: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Any term in title or category, and a value range."""
    return faceted(tenders, terms, columns=("title", "category"), low=low, high=high).select("tender_id", "title", "category", "estimated_value_mkd")


SEARCHED = ("title", "procuring_entity", "category", "winner", "cpv_code")


def faceted(
    tenders: DataFrame, terms: list[str] | None = None, *, columns: tuple[str, ...] = SEARCHED, category: str | None = None, statuses: list[str] | None = None, procedures: list[str] | None = None, buyer: str | None = None,
    cpv_prefix: str | None = None, low: float | None = None, high: float | None = None, published: tuple[date | None, date | None] = (None, None), closing: tuple[date | None, date | None] = (None, None),
) -> DataFrame:
    """Tenders that fit all facets given: any term in any of ``columns`` (upper and lower case alike), equal category, status or
    procedure of a list, part of the buyer's name, beginning of the code, and ranges of value and dates, ends included."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    tests = []
    if terms:
        tests.append(reduce(lambda a, b: a | b, [F.contains(text(c), F.lit(t.lower())) for t in terms for c in columns]))
    tests += [F.col(c) == v for c, v in (("category", category),) if v is not None]
    tests += [F.col(c).isin(*v) for c, v in (("status", statuses), ("procedure_type", procedures)) if v is not None]
    tests += [F.contains(text("procuring_entity"), F.lit(buyer.lower()))] if buyer else []
    tests += [F.col("cpv_code").startswith(cpv_prefix)] if cpv_prefix else []
    for c, (first, last) in (("estimated_value_mkd", (low, high)), ("publication_date", published), ("closing_date", closing)):
        tests += [F.col(c) >= F.lit(first)] if first is not None else []
        tests += [F.col(c) <= F.lit(last)] if last is not None else []
    return reduce(lambda df, t: df.filter(t), tests, tenders)



def page(tenders: DataFrame, after: tuple[date, str], size: int = 20) -> DataFrame:
    """Keyset pagination, newest first: the rows that follow ``after`` (publication date, tender_id)."""
    d, i = after
    follows = (F.col("publication_date") < F.lit(d)) | ((F.col("publication_date") == F.lit(d)) & (F.col("tender_id") > i))
    return tenders.filter(follows).orderBy(F.col("publication_date").desc_nulls_last(), "tender_id").limit(size).select("tender_id", "publication_date", "estimated_value_mkd")
