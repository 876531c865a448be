"""Company, buyer and marketplace panels, funnels, alert bookkeeping and document checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.cleaning import search_variants
from bidscope.operators.cases import keyword_places
from bidscope.operators.detectors import AWARDED, won


def row_count() -> Column:
    return F.count(F.lit(1))


def top(df: DataFrame, by: list, k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def status_counts(tenders: DataFrame) -> DataFrame:
    """Tenders and value by status, category and procedure in one pass (grouping sets), with the grain named."""
    sets = tenders.groupingSets([["status"], ["category"], ["procedure_type"], []], "status", "category", "procedure_type").agg(F.grouping_id().alias("g"), row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"))
    grain = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "category").when(F.col("g") == 6, "procedure").otherwise("all")
    return sets.select(grain.alias("grain"), F.coalesce("status", "category", "procedure_type").alias("value"), "tenders", "estimated")


def trend(tenders: DataFrame, unit: str) -> DataFrame:
    return tenders.groupBy(F.date_trunc(unit, "publication_date").cast("date").alias("period")).agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"), F.sum("actual_value_mkd").alias("actual"))


def value_changes(amendments: DataFrame) -> DataFrame:
    """Per tender its changes of the value in order."""
    own = amendments.filter("field_changed = 'estimated_value_mkd'")
    dates = F.transform(F.sort_array(F.collect_list(F.struct("amendment_date", "n"))), lambda c: c["amendment_date"].cast("string"))
    return own.groupBy("tender_id").agg(row_count().alias("changes"), F.array_join(dates, ",").alias("dates"))


def company_profile(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per company: bids, wins, value, first and last bid, single-bid wins, wins with short deadlines, mean distance from estimates."""
    j = bidders.join(tenders.select("tender_id", "publication_date", "closing_date", "estimated_value_mkd", "num_bidders"), "tender_id")
    w = F.col("is_winner")
    off = F.try_divide((F.col("bid_amount_mkd") - F.col("estimated_value_mkd")) * 100, F.col("estimated_value_mkd"))
    return j.groupBy("company_name").agg(
        row_count().alias("bids"), F.count_if(w).alias("wins"), F.sum(F.when(w, F.col("bid_amount_mkd"))).alias("value"), F.min("publication_date").alias("first_bid"), F.max("publication_date").alias("last_bid"),
        F.count_if(w & (F.col("num_bidders") == 1)).alias("single_bid_wins"), F.count_if(w & (F.datediff("closing_date", "publication_date") < 7)).alias("short_deadline_wins"), F.round(F.avg(off), 4).alias("from_estimate"),
    )


def rivals(bidders: DataFrame, k: int = 3) -> DataFrame:
    """For each company those it meets most: tenders together, wins of each, share of its own tenders."""
    one = bidders.select("tender_id", "company_name", "is_winner")
    other = one.select("tender_id", F.col("company_name").alias("rival"), F.col("is_winner").alias("rival_won"))
    met = one.join(other, "tender_id").filter("company_name <> rival").groupBy("company_name", "rival").agg(row_count().alias("together"), F.count_if("is_winner").alias("our_wins"), F.count_if("rival_won").alias("their_wins"))
    total = one.groupBy("company_name").agg(F.count_distinct("tender_id").alias("n"))
    place = F.row_number().over(Window.partitionBy("company_name").orderBy(F.desc("together"), "rival"))
    return met.join(total, "company_name").withColumn("place", place).filter(F.col("place") <= k).select("company_name", "rival", "together", "our_wins", "their_wins", F.round(F.col("together") * 100.0 / F.col("n"), 4).alias("share"))


def overlap_of_smaller(bidders: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of companies with the share of the smaller one's tenders that they have in common."""
    one = bidders.select("tender_id", "company_name").distinct()
    n = one.groupBy("company_name").agg(row_count().alias("n"))
    a, b = one.withColumnRenamed("company_name", "a"), one.withColumnRenamed("company_name", "b")
    pairs = a.join(b, "tender_id").filter("a < b").groupBy("a", "b").agg(row_count().alias("shared")).filter(F.col("shared") >= least)
    j = pairs.join(n.select(F.col("company_name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("company_name").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "shared", F.round(F.col("shared") * 100.0 / F.least("na", "nb"), 4).alias("overlap"))


def best_months(tenders: DataFrame, as_of: date, years: int = 2) -> DataFrame:
    recent = won(tenders).filter(F.col("publication_date") >= F.add_months(F.lit(as_of), -12 * years))
    return recent.groupBy(F.month("publication_date").alias("month")).agg(row_count().alias("awards"), F.round(F.avg("num_bidders"), 4).alias("mean_bidders"), F.round(F.avg("actual_value_mkd"), 4).alias("mean_value"))


def price_recommendation(items: DataFrame, word: str) -> DataFrame:
    own = items.filter(F.lower("name").contains(word.lower()) & (F.col("unit_price") > 0))
    q = lambda p: F.round(F.percentile("unit_price", p), 6)
    return own.agg(row_count().alias("n"), F.min("unit_price").alias("low"), q(0.25).alias("q1"), F.round(F.avg("unit_price"), 6).alias("mean"), q(0.75).alias("q3"), F.max("unit_price").alias("high"))


def item_price_trend(items: DataFrame) -> DataFrame:
    """Per item the mean price of the last third of its offers against the first third."""
    third = F.ntile(3).over(Window.partitionBy("name").orderBy("offered_on", "tender_id", "company_name", "unit_price"))
    per = items.withColumn("third", third).groupBy("name").agg(F.avg(F.when(F.col("third") == 1, F.col("unit_price"))).alias("a"), F.avg(F.when(F.col("third") == 3, F.col("unit_price"))).alias("b"))
    return per.select("name", F.round(F.try_divide((F.col("b") - F.col("a")) * 100, F.col("a")), 4).alias("change"))


def product_search(items: DataFrame, term: str) -> DataFrame:
    """Items that hold a term, per year: lines, offering companies, prices."""
    return items.filter(F.lower("name").contains(term.lower())).groupBy("name", F.year("offered_on").alias("year")).agg(row_count().alias("lines"), F.count_distinct("company_name").alias("companies"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))


def imputed_prices(items: DataFrame, hidden: Column, least: int = 3) -> DataFrame:
    """Prices marked as hidden are filled from their category's mean (of ``least`` rows at least), then from the name's, with the source named."""
    known = items.withColumn("price", F.when(~hidden, F.col("unit_price")))
    by_code = known.groupBy("cpv_code").agg(F.avg("price").alias("code_mean"), F.count("price").alias("code_n"))
    by_name = known.groupBy("name").agg(F.avg("price").alias("name_mean"), F.count("price").alias("name_n"))
    j = known.join(by_code, "cpv_code").join(by_name, "name")
    from_code = F.when(F.col("code_n") >= least, F.col("code_mean"))
    from_name = F.when(F.col("name_n") >= 2, F.col("name_mean"))
    source = F.when(F.col("price").isNotNull(), "offer").when(from_code.isNotNull(), "category").when(from_name.isNotNull(), "name").otherwise("none")
    return j.select(source.alias("source"), F.coalesce("price", from_code, from_name).alias("price")).groupBy("source").agg(row_count().alias("items"), F.round(F.avg("price"), 4).alias("mean_price"))


def platform_statistics(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: users, events, active days, documents and their characters."""
    a = events.agg(F.count_distinct("user_id").alias("users"), row_count().alias("events"), F.count_distinct(F.to_date("ts")).alias("days"))
    return a.crossJoin(documents.agg(row_count().alias("documents"), F.sum("n_chars").alias("characters")))  # one row each


def funnel(events: DataFrame) -> DataFrame:
    """Users by how far they came: viewed, clicked after a view, bought after a click."""
    first = events.groupBy("user_id").agg(*[F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(k) for k in ("view", "click", "purchase")])
    clicked = F.col("click") > F.col("view")
    return first.agg(F.count("view").alias("viewed"), F.count_if(clicked).alias("clicked"), F.count_if(clicked & (F.col("purchase") > F.col("click"))).alias("bought"))


def usage_limits(events: DataFrame, limit: int) -> DataFrame:
    """Users and days with more events than a day's limit."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(row_count().alias("events")).filter(F.col("events") > limit)


def engagement(events: DataFrame, k: int = 20) -> DataFrame:
    """The k most engaged users: purchases count five, clicks two, all else one."""
    points = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 2).otherwise(1)
    return top(events.groupBy("user_id").agg(F.sum(points).alias("points"), row_count().alias("events")), [F.desc("points"), "user_id"], k)


def saved_search_counts(tenders: DataFrame, searches: DataFrame, *, longest: int = 8) -> DataFrame:
    """Matches per saved search (search_id, cpv_prefix, low, high), searches without any included.

    A tender stands for each beginning of its code, of ``longest`` digits at most, and meets the searches of that prefix.
    """
    code = F.substring("cpv_code", 1, longest)
    starts = F.transform(F.sequence(F.lit(0), F.length(code)), lambda n: F.substring(code, F.lit(1), n))
    each = tenders.filter("cpv_code is not null").select("estimated_value_mkd", F.explode(starts).alias("cpv_prefix"))
    hits = each.join(searches, "cpv_prefix").filter("estimated_value_mkd between low and high").groupBy("search_id").agg(row_count().alias("matches"))
    return searches.select("search_id").join(hits, "search_id", "left").fillna(0, ["matches"])


def unmatched_winners(tenders: DataFrame, contacts: DataFrame) -> DataFrame:
    """Winners without a contact (name), by value."""
    return won(tenders).groupBy(F.col("winner").alias("name")).agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value")).join(contacts, "name", "left_anti")


def document_anomalies(docs: DataFrame, tender_of: Column) -> DataFrame:
    """Per tender: documents, tiny ones, contents that it repeats, and points for both."""
    d = docs.select(tender_of.alias("tender"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("h"))
    per = d.groupBy("tender").agg(row_count().alias("documents"), F.count_if(F.col("n") < 100).alias("tiny"), F.count_distinct("h").alias("contents"))
    repeated = F.col("documents") - F.col("contents")
    return per.select("tender", "documents", "tiny", repeated.alias("repeated"), F.least(F.lit(100), F.col("tiny") * 10 + repeated * 20).cast("int").alias("points"))


def snapshot_differences(old: DataFrame, new: DataFrame, key: str, fields: list[str], least: float = 0.8) -> DataFrame:
    """(key, field, kind): normalized fields that differ by edit distance, or were filled since."""
    b = new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    rows = []
    for f in fields:
        x, y = F.lower(F.trim(F.col(f).cast("string"))), F.lower(F.trim(F.col(f"n_{f}")))
        likeness = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
        rows.append(F.struct(F.lit(f).alias("field"), F.when(x.isNull() & y.isNotNull(), "filled").when(likeness < least, "changed").alias("kind")))
    return old.join(b, key).select(key, F.explode(F.array(*rows)).alias("d")).select(key, "d.field", "d.kind").filter("kind is not null")


def compare_companies(tenders: DataFrame, names: list[str]) -> DataFrame:
    """Totals per named company and year."""
    own = won(tenders).filter(F.col("winner").isin(*names))
    return own.groupBy("winner", F.year("publication_date").alias("year")).agg(row_count().alias("wins"), F.sum("actual_value_mkd").alias("value"), F.count_distinct("category").alias("categories"), F.count_distinct("procuring_entity").alias("buyers"))


def bipartite_edges(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """(src, dst, kind): company bid on tender, company won tender, tender procured by buyer."""
    bid = bidders.select(F.col("company_name").alias("src"), F.col("tender_id").alias("dst"), F.when(F.col("is_winner"), "won").otherwise("bid_on").alias("kind"))
    return bid.unionByName(tenders.select(F.col("tender_id").alias("src"), F.col("procuring_entity").alias("dst"), F.lit("procured_by").alias("kind")))


def open_pool(tenders: DataFrame, prefs: DataFrame, k: int = 5) -> DataFrame:
    """Per user (user_id, sector, cpv4, buyer, budget) the k best open tenders: .3, and .25 for the sector, .2 for the first four
    digits of the code, .2 for a buyer whose name holds the user's, .1 within budget, 1 at most.

    Users meet tenders by sector, by code or by buyer, not all tenders; those with none of these get none.
    """
    base = tenders.filter(~F.col("status").isin(*AWARDED)).select("tender_id", "category", F.substring("cpv_code", 1, 4).alias("code"), "procuring_entity", "estimated_value_mkd")
    names = keyword_places(base.select(F.col("procuring_entity").alias("value")), prefs.select(F.col("buyer").alias("keyword")))
    by_sector = base.join(prefs.select("user_id", F.col("sector").alias("category")), "category").select("user_id", "tender_id")
    by_code = base.join(prefs.select("user_id", F.col("cpv4").alias("code")), "code").select("user_id", "tender_id")
    by_buyer = base.join(names, F.col("procuring_entity") == F.col("value")).join(prefs.select("user_id", F.col("buyer").alias("keyword")), "keyword").select("user_id", "tender_id")
    pairs = by_sector.unionByName(by_code).unionByName(by_buyer).distinct()
    yes = lambda hit, points: F.when(hit, points).otherwise(0.0)
    has_buyer = F.contains(F.lower("procuring_entity"), F.lower("buyer"))
    score = F.lit(0.3) + yes(F.col("category") == F.col("sector"), 0.25) + yes(F.col("code") == F.col("cpv4"), 0.2) + yes(has_buyer, 0.2) + yes(F.col("estimated_value_mkd") <= F.col("budget"), 0.1)
    scored = pairs.join(base, "tender_id").join(prefs, "user_id").select("user_id", "tender_id", F.round(F.least(F.lit(1.0), score), 4).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "tender_id"))).filter(F.col("place") <= k)


def win_rates(bidders: DataFrame, least: int = 5) -> DataFrame:
    """Companies of some bids by their share won."""
    per = bidders.groupBy("company_name").agg(row_count().alias("bids"), F.count_if("is_winner").alias("wins")).filter(F.col("bids") >= least)
    return per.withColumn("win_rate", F.round(F.col("wins") * 100.0 / F.col("bids"), 4))


def top_tenders(tenders: DataFrame, k: int = 20) -> DataFrame:
    """The k tenders of highest estimate."""
    return top(tenders.select("tender_id", "procuring_entity", "estimated_value_mkd", "winner"), [F.col("estimated_value_mkd").desc_nulls_last(), "tender_id"], k)


def _within(column: str):
    return lambda part: F.contains(F.lower(column), F.lower(part))


def flag_search(flags: DataFrame, tenders: DataFrame, *, severities: tuple[str, ...], flag_type: str, least_score: int, buyer: str | None = None, winner: str | None = None) -> DataFrame:
    """Flagged tenders of some severity and score that have a flag of one type, with all their types.

    ``buyer`` and ``winner`` are parts of names, upper and lower case alike; one in Latin letters finds Cyrillic names too.
    """
    per = flags.groupBy("tender_id").agg(F.collect_set("flag_type").alias("kinds"), F.max(F.when(F.col("severity").isin(*severities), F.col("score"))).alias("score"))
    hit = per.filter(F.array_contains("kinds", flag_type) & (F.col("score") >= least_score))
    named = tenders.select("tender_id", "procuring_entity", "winner")
    for column, part in (("procuring_entity", buyer), ("winner", winner)):
        if part:
            named = named.filter(F.exists(search_variants(F.lit(part)), _within(column)))
    return hit.join(named, "tender_id").select("tender_id", "score", F.array_join(F.sort_array("kinds"), ",").alias("types"), "procuring_entity", "winner")
