"""Profiles and rankings of buyers, companies, categories and products; each is a few aggregations over the domain tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.operators.detectors import won
from bidscope.operators.risk import severity_rank


def row_count() -> Column:
    return F.count(F.lit(1))


def best(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, numbered in ``place``; Spark limits ranks before it shuffles, too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def competitors(bidders: DataFrame, tenders: DataFrame, category: str, k: int = 10) -> DataFrame:
    """The companies with most wins among a category's bids, and the row of all of them together (place 0)."""
    j = bidders.join(tenders.filter(F.col("category") == category).select("tender_id"), "tender_id", "left_semi")
    sums = [row_count().alias("bids"), F.count_if("is_winner").alias("wins"), F.sum(F.when(F.col("is_winner"), F.col("bid_amount_mkd"))).alias("value")]
    both = j.groupingSets([["company_name"], []], "company_name").agg(F.grouping_id().alias("all"), *sums)
    place = F.row_number().over(Window.partitionBy("all").orderBy(F.desc("wins"), F.desc("bids"), "company_name"))  # one row for each company of the category
    return both.withColumn("place", F.when(F.col("all") == 0, place).otherwise(0)).filter(F.col("place") <= k).drop("all")


def tracked_competitors(tenders: DataFrame, k: int = 3) -> DataFrame:
    """(winner, awards, value, categories): each winner with its most frequent categories as JSON."""
    w = won(tenders)
    total = w.groupBy("winner").agg(row_count().alias("awards"), F.sum("actual_value_mkd").alias("value"))
    per = best(w.filter("category is not null").groupBy("winner", "category").agg(row_count().alias("n")), ["winner"], [F.desc("n"), F.col("category")], k)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", "category", "n"))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n")))
    return total.join(per.groupBy("winner").agg(F.to_json(rows).alias("categories")), "winner", "left")


def overview(tenders: DataFrame, as_of: date) -> DataFrame:
    """One row of counters."""
    day = F.lit(as_of)
    return tenders.agg(
        row_count().alias("tenders"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "awarded").alias("awarded"), F.count_if(F.col("closing_date").between(day, F.date_add(day, 7))).alias("closing_soon"),
        F.count_distinct("category").alias("categories"), F.count_distinct("procuring_entity").alias("buyers"), F.sum("estimated_value_mkd").alias("estimated"), F.count_if(F.col("publication_date") >= F.date_sub(day, 30)).alias("recent"),
    )


def divisions(tenders: DataFrame) -> DataFrame:
    """Tenders, awards and value of each CPV division, with its distinct codes."""
    return tenders.filter("cpv_code is not null").groupBy(F.substring("cpv_code", 1, 2).alias("division")).agg(
        row_count().alias("tenders"), F.count("winner").alias("awards"), F.sum("estimated_value_mkd").alias("estimated"), F.count_distinct("cpv_code").alias("codes"), F.count_distinct("category").alias("categories")
    )


def country_statistics(buyers: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per country, those without tenders included; a buyer's country is what stands before the bar in its name."""
    per = tenders.groupBy(F.split_part("procuring_entity", F.lit("|"), F.lit(1)).alias("country")).agg(
        row_count().alias("tenders"), F.count_distinct("procuring_entity").alias("buyers"), F.count_distinct("winner").alias("winners"), F.sum("actual_value_mkd").alias("value")
    )
    return buyers.select("country").distinct().join(per, "country", "left").fillna(0, ["tenders", "buyers", "winners"])


def supplier_details(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """(company_name, kind, value, wins, amount): what each company won by category and by buyer."""
    j = bidders.filter("is_winner").join(tenders.select("tender_id", "category", "procuring_entity"), "tender_id")
    kinds = F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("buyer").alias("kind"), F.col("procuring_entity").alias("value"))))
    each = j.select("company_name", "bid_amount_mkd", kinds.alias("k")).select("company_name", "bid_amount_mkd", "k.kind", "k.value")
    return each.filter("value is not null").groupBy("company_name", "kind", "value").agg(row_count().alias("wins"), F.sum("bid_amount_mkd").alias("amount"))


def totals(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """(kind, name, tenders, wins, value, win_rate): the totals kept for each supplier and buyer, computed anew."""
    s = bidders.groupBy(F.col("company_name").alias("name")).agg(row_count().alias("tenders"), F.count_if("is_winner").alias("wins"), F.coalesce(F.sum(F.when(F.col("is_winner"), F.col("bid_amount_mkd"))), F.lit(0.0)).alias("value"))
    b = tenders.groupBy(F.col("procuring_entity").alias("name")).agg(row_count().alias("tenders"), F.count("winner").alias("wins"), F.coalesce(F.sum("actual_value_mkd"), F.lit(0.0)).alias("value"))
    both = s.withColumn("kind", F.lit("supplier")).unionByName(b.withColumn("kind", F.lit("buyer")))
    return both.withColumn("win_rate", F.round(F.col("wins") * 100.0 / F.col("tenders"), 4))


def buyer_list(tenders: DataFrame, term: str, k: int = 20) -> DataFrame:
    """Buyers whose names contain a term, by number of tenders."""
    per = tenders.filter(F.contains(F.lower("procuring_entity"), F.lit(term.lower()))).groupBy("procuring_entity").agg(
        row_count().alias("tenders"), F.count_if(F.col("status") == "open").alias("open"), F.sum("estimated_value_mkd").alias("estimated"), F.round(F.avg("num_bidders"), 4).alias("mean_bidders"), F.max("publication_date").alias("last")
    )
    return per.orderBy(F.desc("tenders"), "procuring_entity").limit(k)


def product_names(items: DataFrame, term: str, k: int = 25) -> DataFrame:
    """The most offered products that a term suggests, with their prices and sellers."""
    per = items.filter(F.contains(F.lower("name"), F.lit(term.lower()))).groupBy("name").agg(
        row_count().alias("lines"), F.sum("quantity").alias("quantity"), F.round(F.avg("unit_price"), 4).alias("mean_price"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"), F.count_distinct("company_name").alias("sellers")
    )
    return per.orderBy(F.desc("lines"), "name").limit(k)


def recent_awards(tenders: DataFrame, as_of: date, days: int, least: float) -> DataFrame:
    """Awards of the last days from a value on, with their distance from the estimate."""
    w = won(tenders).filter(F.col("contract_signing_date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)) & (F.col("actual_value_mkd") >= least))
    change = F.round((F.col("actual_value_mkd") - F.col("estimated_value_mkd")) * 100.0 / F.nullif("estimated_value_mkd", F.lit(0.0)), 4)
    return w.select("tender_id", "winner", "contract_signing_date", "actual_value_mkd", change.alias("from_estimate"))


def offers_against_market(items: DataFrame) -> DataFrame:
    """Each offer of a product beside the lowest, mean and highest price of the product."""
    market = items.groupBy("name").agg(F.min("unit_price").alias("low"), F.avg("unit_price").alias("mean"), F.max("unit_price").alias("high"), row_count().alias("offers"))
    j = items.join(market, "name")
    off = (F.col("unit_price") - F.col("mean")) * 100 / F.col("mean")
    return j.groupBy("company_name", "name").agg(row_count().alias("own"), F.min("offers").alias("offers"), F.min("low").alias("low"), F.max("high").alias("high"), F.round(F.avg(off), 4).alias("off"))


def price_hints(items: DataFrame, terms: list[str], k: int = 3) -> DataFrame:
    """For each term the brands offered most, with their prices."""
    found = items.withColumn("term", F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("name"), t))))
    per = found.groupBy("term", "brand").agg(row_count().alias("offers"), F.round(F.avg("unit_price"), 4).alias("mean_price"), F.min("unit_price").alias("low"))
    return best(per, ["term"], [F.desc("offers"), F.col("brand")], k)


def status_overview(tenders: DataFrame) -> DataFrame:
    return tenders.groupBy("status").agg(
        row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"), F.round(F.avg("num_bidders"), 4).alias("mean_bidders"), F.count_distinct("procuring_entity").alias("buyers"), F.max("publication_date").alias("last")
    )


def buyer_ranking(tenders: DataFrame, k: int = 30) -> DataFrame:
    """Buyers by number of awards: mean offers, what was saved against estimates, the leading winner."""
    w = won(tenders)
    saved = F.sum(F.col("estimated_value_mkd") - F.col("actual_value_mkd")) * 100.0 / F.sum("estimated_value_mkd")
    per = w.groupBy("procuring_entity").agg(row_count().alias("awards"), F.round(F.avg("num_bidders"), 4).alias("mean_offers"), F.round(saved, 4).alias("saved_percent"))
    leader = best(w.groupBy("procuring_entity", "winner").agg(row_count().alias("n")), ["procuring_entity"], [F.desc("n"), F.col("winner")], 1).select("procuring_entity", F.col("winner").alias("leader"))
    return per.orderBy(F.desc("awards"), "procuring_entity").limit(k).join(leader, "procuring_entity", "left")


def supplier_statistics(bidders: DataFrame, tenders: DataFrame, as_of: date) -> DataFrame:
    """Per company: offers, wins, range of offers, and the win rates of the last six and twelve months of days."""
    j = bidders.join(tenders.select("tender_id", "publication_date"), "tender_id")
    since = lambda days: F.col("publication_date") >= F.date_sub(F.lit(as_of), days)
    rate = lambda days: F.round(F.count_if(since(days) & F.col("is_winner")) * 100.0 / F.nullif(F.count_if(since(days)), F.lit(0)), 4)
    months = F.count_distinct(F.date_trunc("month", "publication_date"))
    return j.groupBy("company_name").agg(row_count().alias("offers"), F.count_if("is_winner").alias("wins"), F.min("bid_amount_mkd").alias("low"), F.max("bid_amount_mkd").alias("high"), months.alias("months"), rate(182).alias("half_year"), rate(365).alias("year"))


def scored_leads(companies: DataFrame, events: DataFrame, least: int = 40) -> DataFrame:
    """Companies worth approaching: points for size, recent activity and wins, those that signed up already left out.

    ``companies`` has (company_name, user_id, bids, wins); ``events`` (user_id, event_type).
    """
    seen = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    signed = events.filter("event_type = 'signup'").select("user_id").distinct()
    j = companies.join(signed, "user_id", "left_anti").join(seen, "user_id", "left").fillna(0, ["views", "clicks"])
    score = F.least(F.col("bids") / 10, F.lit(30)) + F.least(F.col("wins") * 2, F.lit(30)) + F.least(F.col("views") + 2 * F.col("clicks"), F.lit(40))
    return j.select("company_name", "user_id", F.floor(score).cast("int").alias("score")).filter(F.col("score") >= least)


def sector_insights(tenders: DataFrame, interests: DataFrame, as_of: date) -> DataFrame:
    """Per user (user_id, sector): open tenders of the sector, their mean budget, how many close soon, and the trend of a quarter."""
    day = F.lit(as_of)
    recent, earlier = F.col("publication_date") >= F.date_sub(day, 90), F.col("publication_date").between(F.date_sub(day, 180), F.date_sub(day, 91))
    per = tenders.groupBy(F.col("category").alias("sector")).agg(
        F.count_if(F.col("status") == "open").alias("open"), F.round(F.avg(F.when(F.col("status") == "open", F.col("estimated_value_mkd"))), 4).alias("mean_budget"),
        F.count_if((F.col("status") == "open") & F.col("closing_date").between(day, F.date_add(day, 14))).alias("closing_soon"), F.count_if(recent).alias("recent"), F.count_if(earlier).alias("earlier"),
    )
    return interests.join(per, "sector").withColumn("trending", F.col("recent") > F.col("earlier"))


def related_companies(tenders: DataFrame, bidders: DataFrame, as_of: date, days: int = 60) -> DataFrame:
    """(category, company_name): who might care about a category's new awards: its earlier winners that won none of them."""
    w = won(tenders).select("category", "winner", "publication_date").filter("category is not null")
    fresh = w.filter(F.col("publication_date") >= F.date_sub(F.lit(as_of), days)).select("category", "winner").distinct()
    older = w.select("category", "winner").distinct()
    return older.join(fresh.select("category").distinct(), "category", "left_semi").join(fresh, ["category", "winner"], "left_anti").select("category", F.col("winner").alias("company_name"))


def best_contacts(contacts: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(company_id, email): the address of most confidence, personal ones before others, none of the suppressed."""
    left = contacts.join(suppressed.select("email").distinct(), "email", "left_anti")
    return best(left, ["company_id"], [F.desc("confidence"), F.col("role_based"), F.col("email")], 1).select("company_id", "email", "confidence")


def sector_bidding(tenders: DataFrame, bidders: DataFrame, k: int = 5) -> DataFrame:
    """Per category at the grain of tenders: bids for each, value against estimate, and the leading winners as text."""
    per_tender = bidders.groupBy("tender_id").agg(row_count().alias("bids"))
    t = tenders.filter("category is not null").join(per_tender, "tender_id", "left")
    sums = t.groupBy("category").agg(row_count().alias("tenders"), F.round(F.avg("bids"), 4).alias("bids_each"), F.round(F.sum("actual_value_mkd") * 100.0 / F.sum(F.when(F.col("actual_value_mkd").isNotNull(), F.col("estimated_value_mkd"))), 4).alias("value_ratio_pct"))
    lead = best(won(tenders).groupBy("category", "winner").agg(row_count().alias("n")), ["category"], [F.desc("n"), F.col("winner")], k)
    names = lead.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "winner"))), lambda x: x["winner"]), ",").alias("leaders"))
    return sums.join(names, "category", "left")


def grouped_statistics(tenders: DataFrame) -> DataFrame:
    """(grain, key, tenders, awards, value): totals by buyer, winner, year, division, status, month and over all, in one pass."""
    t = tenders.select(
        F.col("procuring_entity").alias("buyer"), "winner", F.year("publication_date").cast("string").alias("year"), F.substring("cpv_code", 1, 2).alias("division"), "status", F.date_format("publication_date", "yyyy-MM").alias("month"),
        F.col("actual_value_mkd").alias("v"),
    )
    grains = ["buyer", "winner", "year", "division", "status", "month"]
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.col(g).alias("key")) for g in grains], F.struct(F.lit("all").alias("grain"), F.lit("all").alias("key"))))
    each = t.select(rows.alias("r"), "v").select("r.grain", "r.key", "v").filter("key is not null")
    return each.groupBy("grain", "key").agg(row_count().alias("tenders"), F.count("v").alias("awards"), F.sum("v").alias("value"))


def risk_lists(flags: DataFrame, tenders: DataFrame) -> DataFrame:
    """(grain, name, flags, total_score, worst): flags summed by tender, buyer and company; the worst severity by rank."""
    j = flags.join(tenders.select("tender_id", "procuring_entity", "winner"), "tender_id")
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.col(c).alias("name")) for g, c in (("tender", "tender_id"), ("buyer", "procuring_entity"), ("company", "winner"))]))
    each = j.select(rows.alias("r"), "score", severity_rank(F.col("severity")).alias("rank")).select("r.grain", "r.name", "score", "rank").filter("name is not null")
    return each.groupBy("grain", "name").agg(row_count().alias("flags"), F.sum("score").alias("total_score"), F.max("rank").alias("worst"))


def company_wins(tenders: DataFrame, k: int = 3) -> DataFrame:
    """Per company: wins, value, first and last, its leading sectors and its most recent awards as text."""
    w = won(tenders)
    total = w.groupBy("winner").agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value"), F.min("publication_date").alias("first"), F.max("publication_date").alias("last"))
    listed = lambda df, column, name: df.groupBy("winner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", column))), lambda x: x[column]), ",").alias(name))
    sectors = best(w.filter("category is not null").groupBy("winner", "category").agg(row_count().alias("n")), ["winner"], [F.desc("n"), F.col("category")], k)
    recent = best(w.select("winner", "tender_id", "publication_date"), ["winner"], [F.desc("publication_date"), F.col("tender_id")], k)
    return total.join(listed(sectors, "category", "sectors"), "winner", "left").join(listed(recent, "tender_id", "recent"), "winner")


def sector_overview(tenders: DataFrame, as_of: date) -> DataFrame:
    """Per category: totals, the spread of values, winners and buyers, and the tenders of the last twelve months."""
    v = F.col("actual_value_mkd")
    return tenders.filter("category is not null").groupBy("category").agg(
        row_count().alias("tenders"), F.count(v).alias("awards"), F.sum(v).alias("value"), F.min(v).alias("low"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, 0.5), 4).alias("median"), F.max(v).alias("high"),
        F.count_distinct("winner").alias("winners"), F.count_distinct("procuring_entity").alias("buyers"), F.count_if(F.col("publication_date") >= F.add_months(F.lit(as_of), -12)).alias("last_year"),
    )


def company_bid_patterns(bidders: DataFrame, tenders: DataFrame, least: int = 3) -> DataFrame:
    """Per company: bids against estimates, their spread, single-bid and short-deadline wins, categories, frequent co-bidders."""
    j = bidders.join(tenders.select("tender_id", "estimated_value_mkd", "num_bidders", "closing_date", "publication_date", "cpv_code"), "tender_id")
    ratio = F.col("bid_amount_mkd") * 100 / F.nullif("estimated_value_mkd", F.lit(0.0))
    short = F.datediff("closing_date", "publication_date") < 7
    per = j.groupBy("company_name").agg(
        F.round(F.avg(ratio), 4).alias("of_estimate"), F.round(F.stddev_samp(ratio), 4).alias("spread"), F.count_if(F.col("is_winner") & (F.col("num_bidders") == 1)).alias("single_wins"),
        F.count_if(F.col("is_winner") & short).alias("short_wins"), F.count_distinct("cpv_code").alias("codes"),
    )
    one = bidders.select("tender_id", "company_name")
    met = one.join(one.withColumnRenamed("company_name", "other"), "tender_id").filter("company_name <> other").groupBy("company_name", "other").agg(row_count().alias("n")).filter(F.col("n") >= least)
    return per.join(met.groupBy("company_name").agg(row_count().alias("co_bidders")), "company_name", "left").fillna(0, ["co_bidders"])


def buyer_patterns(tenders: DataFrame) -> DataFrame:
    """Per buyer: mean and spread of values, share of deadlines under a week, categories and the share of the leading one."""
    per = tenders.groupBy("procuring_entity").agg(
        row_count().alias("tenders"), F.round(F.avg("estimated_value_mkd"), 4).alias("mean"), F.round(F.stddev_samp("estimated_value_mkd"), 4).alias("spread"),
        F.round(F.count_if(F.datediff("closing_date", "publication_date") < 7) * 100.0 / row_count(), 4).alias("short_share"), F.count_distinct("category").alias("categories"),
    )
    lead = tenders.filter("category is not null").groupBy("procuring_entity", "category").agg(row_count().alias("n")).groupBy("procuring_entity").agg(F.max("n").alias("leading"))
    return per.join(lead, "procuring_entity", "left").withColumn("leading_share", F.round(F.col("leading") * 100.0 / F.col("tenders"), 4)).drop("leading")


def bidder_distribution(tenders: DataFrame) -> DataFrame:
    """Per buyer and number of bidders: tenders and their share, beside the buyer's median number."""
    t = tenders.filter("num_bidders is not null")
    per = t.groupBy("procuring_entity", "num_bidders").agg(row_count().alias("tenders"))
    median = t.groupBy("procuring_entity").agg(F.percentile("num_bidders", 0.5).alias("median"))
    share = F.round(F.col("tenders") * 100.0 / F.sum("tenders").over(Window.partitionBy("procuring_entity")), 4)
    return per.withColumn("share", share).join(median, "procuring_entity")


def co_bidders(bidders: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of companies that met in at least so many tenders."""
    one = bidders.select("tender_id", "company_name")
    return one.join(one.withColumnRenamed("company_name", "other"), "tender_id").filter("company_name < other").groupBy("company_name", "other").agg(row_count().alias("together")).filter(F.col("together") >= least)
