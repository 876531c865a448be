"""Per-tender risk indicators, each computed for all tenders at once.

An indicator returns (tender_id, indicator, category, score, weight, threshold, confidence, triggered, evidence), for the
tenders it can judge: ``evidence`` is JSON, the score is kept within 0 and 100, ``triggered`` compares the unbounded score with the threshold.  Look-back windows are in
days; ``as_of`` stands for today.  History at a buyer is summed per buyer and day before anything is windowed.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.rounding import scaled_round
from bidscope.operators.detectors import AWARDED

YEAR, TWO_YEARS, HALF_YEAR = 365, 730, 182

#: Weight of each indicator.
WEIGHTS = {
    "single_bidder": 1.2,
    "low_participation": 0.9,
    "same_bidder_set": 1.1,
    "bidder_diversity": 0.8,
    "new_bidder_rate": 0.7,
    "market_concentration": 1.0,
    "bidder_turnover": 0.7,
    "geographic_concentration": 0.6,
    "bidder_experience": 0.6,
    "competition_trend": 0.8,
    "price_deviation": 1.0,
    "bid_clustering": 1.2,
    "cover_bidding": 1.1,
    "round_number": 0.7,
    "price_fixing": 1.3,
    "below_market": 0.9,
    "price_variance": 0.8,
    "winner_z_score": 1.0,
    "estimate_match": 1.2,
    "price_sequence": 0.9,
    "short_deadline": 1.0,
    "weekend_publication": 0.8,
    "election_cycle": 0.9,
    "seasonal_pattern": 0.7,
    "amendment_timing": 0.8,
    "last_minute_submission": 0.7,
    "process_duration": 0.7,
    "publication_pattern": 0.6,
    "deadline_extension": 0.7,
    "submission_clustering": 0.8,
    "repeat_winner": 1.2,
}
#: Confidence of those that rest on weaker data; 1 for the others.
CONFIDENCE = {"same_bidder_set": 0.85, "election_cycle": 0.7, "last_minute_submission": 0.6, "publication_pattern": 0.6, "submission_clustering": 0.7}


def ladder(*steps: tuple[Column, float], other: Column | float) -> Column:
    """The score of the first condition that holds."""
    out = other if isinstance(other, Column) else F.lit(float(other))
    for condition, score in reversed(steps):
        out = F.when(condition, float(score)).otherwise(out)
    return out


def at_least_zero(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def bonus(condition: Column, n: float) -> Column:
    return F.when(condition, float(n)).otherwise(0.0)


def evidence_text(measures: dict[str, Column]) -> Column:
    """What a score rests on as a JSON object; numbers have four decimals."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(scaled_round(value, 4).try_cast("decimal(20,4)").cast("string"), F.lit("null"))) for name, value in measures.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def indicator(df: DataFrame, name: str, category: str, threshold: float, score: Column, evidence: dict[str, Column]) -> DataFrame:
    """Scores are rounded to six places, so that the order of summing in statistics doesn't show."""
    raw = scaled_round(score, 6)
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))
    return df.select(
        "tender_id", F.lit(name).alias("indicator"), F.lit(category).alias("category"), clamped.alias("score"), F.lit(WEIGHTS[name]).alias("weight"), F.lit(float(threshold)).alias("threshold"),
        F.lit(CONFIDENCE.get(name, 1.0)).alias("confidence"), (raw >= threshold).alias("triggered"), evidence_text(evidence).alias("evidence"),
    )


def _recent(tenders: DataFrame, as_of: date, days: int) -> DataFrame:
    return tenders.filter(F.col("publication_date") >= F.date_sub(F.lit(as_of), days))


def _before(days: int, *keys: str):
    """Rows of the same keys dated in the ``days`` before this row's date."""
    day = F.datediff("publication_date", F.lit(date(1970, 1, 1)))
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1)


# --- competition ------------------------------------------------------------------------------------------------------


def single_bidder(tenders: DataFrame) -> DataFrame:
    awarded = F.col("status").isin(*AWARDED)
    rows = tenders.withColumn("wins", F.count(F.when(awarded, 1)).over(_before(YEAR, "procuring_entity", "winner"))).filter("num_bidders = 1")
    wins = F.when(F.col("winner").isNull(), 0).otherwise(F.col("wins"))
    score = F.lit(60.0) + bonus(F.col("estimated_value_mkd") > 5e6, 20) + bonus(wins >= 3, 15) + bonus(~F.lower("procedure_type").contains("negotiated"), 10)
    return indicator(rows, "single_bidder", "competition", 60, score, {"wins": wins})


def low_participation(tenders: DataFrame, as_of: date) -> DataFrame:
    stats = _recent(tenders, as_of, YEAR).filter(F.col("status").isin(*AWARDED) & (F.col("num_bidders") > 0)).groupBy("cpv_code").agg(F.avg("num_bidders").alias("mean"), F.stddev_samp("num_bidders").alias("sd"))
    rows = tenders.filter("num_bidders > 0").join(stats, "cpv_code")
    z = F.when(F.col("sd") > 0, (F.col("mean") - F.col("num_bidders")) / F.col("sd")).otherwise(0.0)
    return indicator(rows, "low_participation", "competition", 55, ladder((z >= 2, 80), (z >= 1.5, 65), (z >= 1, 50), other=at_least_zero(30 - F.col("num_bidders") / F.col("mean") * 20)), {"bidders": F.col("num_bidders"), "z": z})


def same_bidder_set(tenders: DataFrame, bidders: DataFrame, as_of: date) -> DataFrame:
    sets = bidders.groupBy("tender_id").agg(F.array_join(F.sort_array(F.collect_list("company_name")), "|").alias("companies"))
    recent = sets.join(_recent(tenders, as_of, TWO_YEARS).select("tender_id", F.lit(1).alias("recent")), "tender_id", "left")
    counts = recent.groupBy("companies").agg(F.count("recent").alias("n"))
    rows = recent.join(counts, "companies").withColumn("matches", F.col("n") - F.coalesce("recent", F.lit(0))).filter("matches > 0")
    m = F.col("matches")
    return indicator(rows, "same_bidder_set", "competition", 65, ladder((m >= 10, 90), (m >= 7, 80), (m >= 5, 70), (m >= 3, 60), other=40), {"matches": m})


def _buyer_scores(tenders: DataFrame, per_buyer: DataFrame) -> DataFrame:
    return tenders.select("tender_id", "procuring_entity").join(per_buyer, "procuring_entity")


def bidder_diversity(tenders: DataFrame, bidders: DataFrame, as_of: date) -> DataFrame:
    counts = bidders.join(_recent(tenders, as_of, YEAR).select("tender_id", "procuring_entity"), "tender_id").groupBy("procuring_entity", "company_name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("procuring_entity").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("companies"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    # -sum p log p = log N - sum n log n / N
    entropy = F.log2("total") - F.col("nlogn") / F.col("total")
    share = F.when(F.col("companies") > 1, entropy / F.log2("companies")).otherwise(0.0)
    return indicator(_buyer_scores(tenders, total), "bidder_diversity", "competition", 60, (1 - share) * 100, {"evenness": share})


def _presence(tenders: DataFrame, bidders: DataFrame, parts: int | None) -> DataFrame:
    """(buyer, company, day, next day, first day) of a company's bids at a buyer, one row per day; dealt by the two in ``parts``."""
    days = bidders.join(tenders.select("tender_id", "procuring_entity", "publication_date"), "tender_id").select("procuring_entity", "company_name", "publication_date")
    days = (days.repartition(parts, "procuring_entity", "company_name") if parts else days).distinct()
    w = Window.partitionBy("procuring_entity", "company_name").orderBy("publication_date")
    return days.select("procuring_entity", "company_name", F.col("publication_date").alias("day"), F.lead("publication_date").over(w).alias("next_day"), F.min("publication_date").over(w).alias("first_day"))


def _level_at(steps: DataFrame, tenders: DataFrame, names: list[str]) -> DataFrame:
    """Running sums per buyer of dated steps, read at each tender's publication date."""
    daily = steps.groupBy("procuring_entity", "date").agg(*[F.sum(n).alias(n) for n in names])
    asked = tenders.select("procuring_entity", F.col("publication_date").alias("date")).distinct().select("procuring_entity", "date", *[F.lit(0).cast("long").alias(n) for n in names])
    both = daily.select("procuring_entity", "date", *[F.col(n).cast("long").alias(n) for n in names]).unionByName(asked).groupBy("procuring_entity", "date").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy("procuring_entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("procuring_entity", F.col("date").alias("publication_date"), *[F.sum(n).over(w).alias(n) for n in names])


def _interval_steps(df: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    """+1 on the day after ``start``, -1 on the day after ``end``: who is present on days in (start, end]."""
    kept = df.select("procuring_entity", start.alias("a"), end.alias("b")).filter("b > a")
    edge = F.explode(F.array(F.struct(F.date_add("a", 1).alias("date"), F.lit(1).alias("step")), F.struct(F.date_add("b", 1).alias("date"), F.lit(-1).alias("step"))))
    return kept.select("procuring_entity", edge.alias("e")).select("procuring_entity", "e.date", F.col("e.step").alias(name))


def new_bidder_rate(tenders: DataFrame, bidders: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Of the companies that bid at the buyer in the year before, the share that had not bid there earlier."""
    p = _presence(tenders, bidders, parts)
    until = F.least(F.date_add("day", YEAR), F.coalesce("next_day", F.date_add("day", YEAR)))
    recent = _interval_steps(p, F.col("day"), until, "recent").withColumn("new", F.lit(0))
    new = _interval_steps(p, F.col("day"), F.least(until, F.date_add("first_day", YEAR)), "new").withColumn("recent", F.lit(0))
    rows = tenders.join(_level_at(recent.unionByName(new), tenders, ["recent", "new"]), ["procuring_entity", "publication_date"]).filter("recent > 0")
    rate = F.col("new") * 100.0 / F.col("recent")
    return indicator(rows, "new_bidder_rate", "competition", 65, ladder((rate < 10, 85), (rate < 20, 70), (rate < 30, 50), other=at_least_zero(40 - rate)), {"rate": rate})


def bidder_turnover(tenders: DataFrame, bidders: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Of the companies that bid at the buyer half a year to a year before, the share that bid again since."""
    p = _presence(tenders, bidders, parts)
    later = _edges(p, F.col("day"), F.least(F.date_add("day", HALF_YEAR), F.coalesce("next_day", F.date_add("day", HALF_YEAR))), "late")
    earlier = _edges(p, F.date_add("day", HALF_YEAR), F.least(F.date_add("day", YEAR), F.coalesce(F.date_add("next_day", HALF_YEAR), F.date_add("day", YEAR))), "early")
    steps = later.withColumn("early", F.lit(0)).unionByName(earlier.withColumn("late", F.lit(0))).groupBy("procuring_entity", "company_name", "date").agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    w = Window.partitionBy("procuring_entity", "company_name").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.select("procuring_entity", "company_name", "date", (F.sum("early").over(upto) > 0).cast("int").alias("e"), ((F.sum("early").over(upto) > 0) & (F.sum("late").over(upto) > 0)).cast("int").alias("b"))
    moves = state.select("procuring_entity", "date", (F.col("e") - F.coalesce(F.lag("e").over(w), F.lit(0))).alias("before"), (F.col("b") - F.coalesce(F.lag("b").over(w), F.lit(0))).alias("kept"))
    rows = tenders.join(_level_at(moves, tenders, ["before", "kept"]), ["procuring_entity", "publication_date"]).filter("before > 0")
    rate = F.col("kept") * 100.0 / F.col("before")
    return indicator(rows, "bidder_turnover", "competition", 65, ladder((rate > 90, 80), (rate > 80, 70), (rate > 70, 55), other=at_least_zero(rate - 30)), {"rate": rate})


def _edges(df: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    kept = df.select("procuring_entity", "company_name", start.alias("a"), end.alias("b")).filter("b > a")
    edge = F.explode(F.array(F.struct(F.date_add("a", 1).alias("date"), F.lit(1).alias("step")), F.struct(F.date_add("b", 1).alias("date"), F.lit(-1).alias("step"))))
    return kept.select("procuring_entity", "company_name", edge.alias("e")).select("procuring_entity", "company_name", "e.date", F.col("e.step").alias(name))


def market_concentration(tenders: DataFrame, as_of: date) -> DataFrame:
    wins = _recent(tenders, as_of, TWO_YEARS).filter(F.col("status").isin(*AWARDED) & F.col("winner").isNotNull()).groupBy("procuring_entity", "winner").agg(F.count(F.lit(1)).alias("n"))
    per = wins.groupBy("procuring_entity").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    hhi = F.col("squares") * 10000.0 / (F.col("total") * F.col("total"))
    return indicator(_buyer_scores(tenders, per), "market_concentration", "competition", 70, ladder((hhi > 2500, 90), (hhi > 1800, 75), (hhi > 1500, 60), other=hhi / 1500 * 40), {"hhi": hhi})


def geographic_concentration(bidders: DataFrame) -> DataFrame:
    cities = bidders.filter("company_city is not null").groupBy("tender_id", "company_city").agg(F.count(F.lit(1)).alias("n")).groupBy("tender_id").agg(F.max("n").alias("most"), F.sum("n").alias("total")).filter("total >= 2")
    pct = F.col("most") * 100.0 / F.col("total")
    return indicator(cities, "geographic_concentration", "competition", 70, ladder((pct == 100, 85), (pct >= 80, 70), (pct >= 60, 55), other=at_least_zero(pct - 20)), {"percent": pct})


def bidder_experience(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """The share of a tender's bidders with fewer than three earlier bids."""
    dated = bidders.join(tenders.select("tender_id", "publication_date"), "tender_id").select("tender_id", "company_name", "publication_date")
    daily = dated.groupBy("company_name", "publication_date").agg(F.count(F.lit(1)).alias("n"))
    before = daily.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("company_name").orderBy("publication_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = dated.join(before, ["company_name", "publication_date"]).groupBy("tender_id").agg(F.count(F.lit(1)).alias("bidders"), F.count_if(F.col("before") < 3).alias("fresh"))
    pct = F.col("fresh") * 100.0 / F.col("bidders")
    return indicator(rows, "bidder_experience", "competition", 65, ladder((pct == 100, 85), (pct >= 75, 70), (pct >= 50, 55), other=at_least_zero(pct - 10)), {"percent": pct})


def competition_trend(tenders: DataFrame, as_of: date) -> DataFrame:
    """Slope of a buyer's monthly mean number of bidders over months with three tenders at least."""
    own = _recent(tenders, as_of, YEAR).filter(F.col("status").isin("awarded", "completed", "active") & F.col("num_bidders").isNotNull())
    months = own.groupBy("procuring_entity", F.date_trunc("month", "publication_date").alias("month")).agg(F.avg("num_bidders").alias("y"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    x = months.withColumn("x", F.row_number().over(Window.partitionBy("procuring_entity").orderBy("month")) - 1)
    slopes = x.groupBy("procuring_entity").agg(F.regr_slope("y", "x").alias("slope"), F.count(F.lit(1)).alias("months")).filter("months >= 3")
    s = F.round("slope", 9)
    return indicator(_buyer_scores(tenders, slopes), "competition_trend", "competition", 65, ladder((s < -0.3, 85), (s < -0.15, 70), (s < 0, 55), other=at_least_zero(30 - s * 20)), {"slope": s})


# --- price --------------------------------------------------------------------------------------------------------------


def price_deviation(tenders: DataFrame) -> DataFrame:
    rows = tenders.filter("estimated_value_mkd > 0 and actual_value_mkd > 0").withColumn("dev", (F.col("actual_value_mkd") - F.col("estimated_value_mkd")) / F.col("estimated_value_mkd") * 100)
    d = F.abs("dev")
    return indicator(rows, "price_deviation", "price", 60, ladder((d > 30, 90), (d > 20, 75), (d > 10, 60), (d > 5, 45), other=d * 5) + bonus((F.col("dev") > 0) & (F.col("num_bidders") == 1), 15), {"deviation": d})


def _variance(values: Column) -> Column:
    """Sample variance of an array, from sums of what lies above its first value.  These are whole numbers for whole amounts, so
    the sums are exact; ``stddev_samp`` changes its last digit with what arrives first, and with it the thresholds and
    roundings that a value meets exactly."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"))
    n = F.size(values)

    def add(s: Column, x: Column) -> Column:
        above = x - F.get(values, F.lit(0))
        return F.struct((s["sum"] + above).alias("sum"), (s["squares"] + above * above).alias("squares"))

    return F.aggregate(values, start, add, lambda s: F.when(n > 1, (n * s["squares"] - s["sum"] * s["sum"]) / (n * (n - 1))))


def _variance_in_order(values: Column) -> Column:
    """Sample variance of an array by the running update that DuckDB has, so that what meets a threshold or a half exactly falls
    to the same side."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, start, add, lambda s: F.when(s["n"] > 1, s["squares"] / (s["n"] - 1)))


def _bid_stats(bidders: DataFrame, least: int) -> DataFrame:
    amount = F.col("bid_amount_mkd")
    bids = bidders.filter(amount > 0).groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("sd"), F.sort_array(F.collect_list(amount)).alias("bids"), F.max(F.when(F.col("is_winner"), amount)).alias("winner_bid")
    ).filter(F.col("n") >= least)
    return bids.withColumn("exact_sd", F.sqrt(_variance(F.col("bids"))))


def bid_clustering(bidders: DataFrame) -> DataFrame:
    rows = _bid_stats(bidders, 3)
    c = F.col("exact_sd") / F.col("mean")
    return indicator(rows, "bid_clustering", "price", 65, ladder((c < 0.01, 95), (c < 0.02, 85), (c < 0.05, 70), (c < 0.10, 50), other=at_least_zero((0.20 - c) * 200)), {"cov": c})


def cover_bidding(bidders: DataFrame) -> DataFrame:
    """The gap from the lowest bid to the next, whoever won."""
    rows = _bid_stats(bidders, 2)
    low, second = F.get("bids", F.lit(0)), F.get("bids", F.lit(1))
    gap = (second - low) / low * 100
    return indicator(rows, "cover_bidding", "price", 70, ladder((gap > 20, 90), (gap > 15, 80), (gap > 10, 70), (gap > 5, 55), other=gap * 8), {"low": low, "second": second})


def round_number(bidders: DataFrame) -> DataFrame:
    a = F.col("bid_amount_mkd")
    rows = bidders.filter(a > 0).groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(a % k == 0).alias(f"r{k}") for k in (10000, 5000, 1000)])
    n, r10, r5, r1 = (F.col(c) for c in ("n", "r10000", "r5000", "r1000"))
    return indicator(rows, "round_number", "price", 60, ladder((r10 == n, 80), (r5 == n, 70), (r1 == n, 60), (r10 / n > 0.7, 65), (r1 / n > 0.8, 50), other=r1 / n * 40), {"share": r1 / n})


def price_fixing(bidders: DataFrame) -> DataFrame:
    same = bidders.filter("bid_amount_mkd > 0").groupBy("tender_id", "bid_amount_mkd").agg(F.count(F.lit(1)).alias("n")).groupBy("tender_id").agg(F.max("n").alias("most")).filter("most > 1")
    return indicator(same, "price_fixing", "price", 80, ladder((F.col("most") >= 3, 95), other=75), {"equal": F.col("most")})


def below_market(tenders: DataFrame, as_of: date, *, least_sample: int = 5) -> DataFrame:
    """Against the other awards of the same category; the tender itself is taken out of sums of its own category."""
    v = F.col("actual_value_mkd")
    recent = (F.col("publication_date") >= F.date_sub(F.lit(as_of), YEAR)) & F.col("status").isin(*AWARDED)
    awarded = tenders.filter(v > 0).withColumn("recent", recent)
    sums = awarded.filter("recent").groupBy("cpv_code").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    rows = awarded.join(sums, "cpv_code")
    own = F.col("recent").cast("int")
    n, s, q = F.col("n") - own, F.col("s") - own * v, F.col("q") - own * v * v
    rows = rows.withColumns({"m": n, "mean": F.try_divide(s, n), "var": F.try_divide(q - F.try_divide(s * s, n), n - 1)}).filter(F.col("m") >= least_sample)
    dev = (v - F.col("mean")) / F.col("mean") * 100
    z = F.when(F.col("var") > 0, (F.col("mean") - v) / F.sqrt("var")).otherwise(0.0)
    return indicator(rows, "below_market", "price", 65, ladder((dev < -50, 90), (dev < -30, 75), (dev < -20, 60), (z > 2, 65), other=F.when(dev < 0, at_least_zero(F.abs(dev) - 10)).otherwise(0.0)), {"deviation": dev})


def price_variance(bidders: DataFrame) -> DataFrame:
    c = F.col("exact_sd") / F.col("mean")
    return indicator(_bid_stats(bidders, 3), "price_variance", "price", 60, ladder((c < 0.02, 85), (c < 0.05, 65), (c > 0.30, 70), (c > 0.20, 50), other=0), {"cov": c})


def winner_z_score(bidders: DataFrame) -> DataFrame:
    z = F.abs(F.when(F.col("sd") > 0, (F.col("winner_bid") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return indicator(_bid_stats(bidders, 3).filter("winner_bid is not null"), "winner_z_score", "price", 65, ladder((z > 3, 90), (z > 2, 75), (z > 1.5, 60), other=z * 30), {"z": z})


def estimate_match(tenders: DataFrame, bidders: DataFrame, *, near: float = 0.01) -> DataFrame:
    t = tenders.filter("estimated_value_mkd > 0").select("tender_id", "estimated_value_mkd")
    close = bidders.filter("bid_amount_mkd > 0").join(t, "tender_id").filter(F.abs(F.col("bid_amount_mkd") - F.col("estimated_value_mkd")) / F.col("estimated_value_mkd") < near)
    return indicator(close.groupBy("tender_id").agg(F.max("is_winner").alias("won")), "estimate_match", "price", 75, F.lit(85.0) + bonus(F.col("won"), 10), {"won": F.col("won").cast("int")})


def price_sequence(bidders: DataFrame) -> DataFrame:
    """Sorted bids at even distances: variance of the distances over their squared mean."""
    rows = _bid_stats(bidders, 3)
    gaps = F.transform(F.slice("bids", 2, F.size("bids") - 1), lambda x, i: x - F.get("bids", i))
    rows = rows.withColumn("gaps", gaps).withColumn("g", F.size("gaps"))
    total = F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x)
    mean = total / F.col("g")
    rel = F.when(mean > 0, _variance_in_order(F.col("gaps")) / (mean * mean)).otherwise(0.0)
    return indicator(rows, "price_sequence", "price", 70, ladder((rel < 0.01, 85), (rel < 0.05, 70), other=0), {"evenness": rel})


# --- timing ---------------------------------------------------------------------------------------------------------------


def short_deadline(tenders: DataFrame) -> DataFrame:
    rows = tenders.withColumn("days", F.datediff("closing_date", "publication_date"))
    d = F.col("days")
    return indicator(rows, "short_deadline", "timing", 60, ladder((d < 3, 95), (d < 5, 85), (d < 7, 70), (d < 10, 55), (d < 14, 40), other=at_least_zero(30.0 - d)) + bonus(F.col("num_bidders") == 1, 15) + bonus(F.col("estimated_value_mkd") > 5e6, 10), {"days": d})


def weekend_publication(tenders: DataFrame) -> DataFrame:
    weekend = F.dayofweek("publication_date").isin(1, 7)
    return indicator(tenders, "weekend_publication", "timing", 65, F.when(weekend, 70.0).otherwise(0.0) + bonus(weekend & F.col("num_bidders").between(1, 2), 15), {"weekend": weekend.cast("int")})


ELECTIONS = (date(1994, 10, 16), date(1998, 10, 18), date(2002, 9, 15))


def election_cycle(tenders: DataFrame, elections: tuple[date, ...] = ELECTIONS) -> DataFrame:
    """Published shortly before the nearest election; of two equally near the earlier counts."""
    gaps = F.array_sort(F.array(*[F.struct(F.abs(F.datediff(F.lit(e), "publication_date")).alias("gap"), F.lit(e).alias("day")) for e in elections]))
    rows = tenders.withColumn("near", F.get(gaps, F.lit(0)))
    gap, ahead = F.col("near.gap"), F.col("publication_date") < F.col("near.day")
    return indicator(rows, "election_cycle", "timing", 65, ladder((ahead & (gap < 30), 80), (ahead & (gap < 60), 70), (ahead & (gap < 90), 60), (gap < 180, 40), other=0), {"days": gap})


def seasonal_pattern(tenders: DataFrame) -> DataFrame:
    """The tender's month against the buyer's other months of that year."""
    keyed = tenders.withColumns({"y": F.year("publication_date"), "m": F.month("publication_date")})
    months = keyed.groupBy("procuring_entity", "y", "m").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("procuring_entity", "y")
    months = months.withColumns({"mean": F.avg("n").over(w), "sd": F.stddev_samp("n").over(w)})
    z = F.round(F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(0.0), 9)
    december = F.col("m") == 12
    rows = keyed.select("tender_id", "procuring_entity", "y", "m").join(months, ["procuring_entity", "y", "m"])
    return indicator(rows, "seasonal_pattern", "timing", 60, ladder((december & (z > 2), 75), (december & (z > 1), 60), (z > 2.5, 70), (z > 2, 55), other=0), {"z": z})


def amendment_timing(amendments: DataFrame) -> DataFrame:
    days = F.datediff("closing_date", "amendment_date")
    rows = amendments.groupBy("tender_id").agg(F.count_if(days < 3).alias("last"), F.count_if(days < 7).alias("late"), F.count(F.lit(1)).alias("n"))
    return indicator(rows, "amendment_timing", "timing", 65, ladder((F.col("last") > 0, 80), (F.col("late") > 0, 65), (F.col("n") > 3, 50), other=0), {"amendments": F.col("n")})


def last_minute_submission(bidders: DataFrame) -> DataFrame:
    m = F.col("minutes_before_close")
    rows = bidders.filter("minutes_before_close is not null").groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(m < 60).alias("hour"), F.count_if(m < 1440).alias("day"))
    n, hour, day = F.col("n"), F.col("hour"), F.col("day")
    return indicator(rows, "last_minute_submission", "timing", 60, ladder(((hour == n) & (n >= 2), 85), ((day == n) & (n >= 3), 70), (hour / n > 0.75, 65), other=0), {"last_hour": hour})


def process_duration(tenders: DataFrame, as_of: date) -> DataFrame:
    days = F.datediff("contract_signing_date", "publication_date")
    t = tenders.withColumn("days", days)
    stats = _recent(t, as_of, YEAR).groupBy("procedure_type").agg(F.avg("days").alias("mean"), F.stddev_samp("days").alias("sd"))
    rows = t.join(F.broadcast(stats), "procedure_type")  # one row per procedure type
    z = F.when(F.col("sd") > 0, (F.floor("mean") - F.col("days")) / F.col("sd")).otherwise(0.0)
    return indicator(rows, "process_duration", "timing", 60, ladder(((z > 2) & (F.col("days") < 14), 80), (z > 1.5, 65), (F.col("days") < 7, 70), other=0), {"days": F.col("days"), "z": z})


def publication_pattern(tenders: DataFrame) -> DataFrame:
    """Off hours or weekend; a date without a time counts as noon."""
    hour = F.hour(F.col("publication_date").cast("timestamp"))
    hour = F.when(hour == 0, 12).otherwise(hour)
    off, weekend = (hour < 7) | (hour >= 19), F.dayofweek("publication_date").isin(1, 7)
    return indicator(tenders, "publication_pattern", "timing", 65, ladder((off & weekend, 85), (off, 65), (weekend, 60), other=0), {"weekend": weekend.cast("int")})


def deadline_extension(amendments: DataFrame) -> DataFrame:
    rows = amendments.filter("field_changed = 'closing_date'").groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"))
    return indicator(rows, "deadline_extension", "timing", 60, ladder((F.col("n") >= 3, 80), (F.col("n") == 2, 65), other=50), {"extensions": F.col("n")})


def submission_clustering(bidders: DataFrame) -> DataFrame:
    """The largest pause between neighbouring submissions."""
    w = Window.partitionBy("tender_id").orderBy("minutes_before_close", "company_name")
    gap = (F.col("minutes_before_close") - F.lag("minutes_before_close").over(w)) * 60
    rows = bidders.filter("minutes_before_close is not null").withColumn("gap", gap).groupBy("tender_id").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    g = F.col("gap")
    return indicator(rows, "submission_clustering", "timing", 70, ladder((g < 300, 90), (g < 900, 80), (g < 3600, 70), other=0), {"seconds": g})


# --- relationship -----------------------------------------------------------------------------------------------------------


def repeat_winner(tenders: DataFrame, as_of: date, *, least_tenders: int = 5) -> DataFrame:
    own = _recent(tenders, as_of, TWO_YEARS).filter(F.col("status").isin(*AWARDED) & F.col("winner").isNotNull())
    wins = own.groupBy("procuring_entity", "winner").agg(F.count(F.lit(1)).alias("wins"))
    stats = wins.join(wins.groupBy("procuring_entity").agg(F.sum("wins").alias("total")), "procuring_entity").filter(F.col("total") >= least_tenders)
    rows = tenders.filter("winner is not null").select("tender_id", "procuring_entity", "winner").join(stats, ["procuring_entity", "winner"])
    pct = F.col("wins") * 100.0 / F.col("total")
    return indicator(rows, "repeat_winner", "relationship", 65, ladder((pct > 80, 95), (pct > 70, 85), (pct > 60, 75), (pct > 50, 60), other=at_least_zero(pct - 20)) + bonus(F.col("wins") > 10, 10), {"wins": F.col("wins"), "percent": pct})


def all_indicators(tenders: DataFrame, bidders: DataFrame, amendments: DataFrame, as_of: date, *, parts: int | None = None) -> DataFrame:
    parts = [
        single_bidder(tenders), low_participation(tenders, as_of), same_bidder_set(tenders, bidders, as_of), bidder_diversity(tenders, bidders, as_of), new_bidder_rate(tenders, bidders, parts=parts), market_concentration(tenders, as_of),
        bidder_turnover(tenders, bidders, parts=parts), geographic_concentration(bidders), bidder_experience(tenders, bidders), competition_trend(tenders, as_of), price_deviation(tenders), bid_clustering(bidders), cover_bidding(bidders),
        round_number(bidders), price_fixing(bidders), below_market(tenders, as_of), price_variance(bidders), winner_z_score(bidders), estimate_match(tenders, bidders), price_sequence(bidders), short_deadline(tenders),
        weekend_publication(tenders), election_cycle(tenders), seasonal_pattern(tenders), amendment_timing(amendments), last_minute_submission(bidders), process_duration(tenders, as_of), publication_pattern(tenders),
        deadline_extension(amendments), submission_clustering(bidders), repeat_winner(tenders, as_of),
    ]
    return reduce(DataFrame.unionByName, parts)
