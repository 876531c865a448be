"""The price features of a tender, and the short set that batch scoring reads, under the names that models expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidscope.workspace import materialize


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def _or_zero(value: Column, test: Column) -> Column:
    return F.coalesce(F.when(test, value), F.lit(0.0))


def price_feature_set(tenders: DataFrame, bidders: DataFrame, *, digits: int = 6) -> DataFrame:
    """(tender_id, 31 numbers): estimate and award, how far they lie apart, how the bids lie, the award among them, and bands of value.

    Bids without an amount don't count; a tender with fewer than two has 0 for all that its bids would say, one without an
    estimate or an award 0 for what compares them.
    """
    v = F.col("bid_amount_mkd")
    bids = bidders.filter(v.isNotNull() & (v != 0)).groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.when(F.col("is_winner"), v)).alias("won")
    )
    est, act = F.coalesce("estimated_value_mkd", F.lit(0.0)), F.coalesce("actual_value_mkd", F.lit(0.0))
    t = tenders.select("tender_id", est.alias("est"), act.alias("act")).join(bids, "tender_id", "left")
    both, apart = (F.col("est") > 0) & (F.col("act") > 0), F.try_divide(F.col("act") - F.col("est"), F.col("est"))
    enough = F.coalesce(F.col("n"), F.lit(0)) >= 2
    bid = F.when(F.col("act") > 0, F.col("act")).otherwise(F.coalesce("won", F.lit(0.0)))
    judged, cov = enough & (bid > 0) & (F.col("mean") > 0), F.try_divide("sd", "mean")
    z = F.try_divide(F.col("mean") - bid, F.col("sd"))
    made = {
        "estimated_value_mkd": F.col("est"), "actual_value_mkd": F.col("act"), "has_estimated_value": _flag(F.col("est") > 0), "has_actual_value": _flag(F.col("act") > 0),
        "price_vs_estimate_ratio": _or_zero(F.try_divide("act", "est"), both), "price_deviation_from_estimate": _or_zero(apart, both), "price_above_estimate": _flag(both & (apart > 0)), "price_below_estimate": _flag(both & (apart < 0)),
        "price_exact_match_estimate": _flag(both & (F.abs(apart) < 0.01)), "price_very_close_estimate": _flag(both & (F.abs(apart) < 0.05)), "price_deviation_large": _flag(both & (F.abs(apart) > 0.2)), "price_deviation_very_large": _flag(both & (F.abs(apart) > 0.5)),
        "bid_mean": _or_zero(F.col("mean"), enough), "bid_median": _or_zero(F.col("median"), enough), "bid_std": _or_zero(F.col("sd"), enough), "bid_min": _or_zero(F.col("low"), enough), "bid_max": _or_zero(F.col("high"), enough), "bid_range": _or_zero(F.col("high") - F.col("low"), enough),
        "bid_coefficient_of_variation": _or_zero(cov, enough), "bid_low_variance": _flag(enough & (cov < 0.05)), "bid_very_low_variance": _flag(enough & (cov < 0.02)),
        "winner_vs_mean_ratio": _or_zero(F.try_divide(bid, F.col("mean")), judged), "winner_vs_median_ratio": _or_zero(F.try_divide(bid, F.col("median")), judged), "winner_bid_z_score": _or_zero(z, judged), "winner_extremely_low": _flag(judged & (z > 2)),
        "value_log": _or_zero(F.log10(F.col("est") + 1), F.col("est") > 0), "value_small": _flag((F.col("est") > 0) & (F.col("est") < 500_000)), "value_medium": _flag((F.col("est") >= 500_000) & (F.col("est") < 5_000_000)), "value_large": _flag((F.col("est") >= 5_000_000) & (F.col("est") < 20_000_000)),
        "value_very_large": _flag(F.col("est") >= 20_000_000),
    }
    return t.select("tender_id", *[F.round(c, digits).alias(n) for n, c in made.items()])


def batch_feature_set(tenders: DataFrame, documents: DataFrame, flags: DataFrame) -> DataFrame:
    """(tender_id, 20 numbers) of all tenders; documents are (tender_id), flags (tender_id, score)."""
    d = documents.groupBy("tender_id").agg(F.count(F.lit(1)).alias("docs"))
    f = flags.groupBy("tender_id").agg(F.count(F.lit(1)).alias("flags"), F.max("score").cast("double").alias("worst"))
    t = tenders.join(d, "tender_id", "left").join(f, "tender_id", "left")
    n, est, act = F.coalesce("num_bidders", F.lit(0)), F.coalesce("estimated_value_mkd", F.lit(0.0)), F.coalesce("actual_value_mkd", F.lit(0.0))
    priced, days = (est > 0) & (act > 0), F.coalesce(F.datediff("closing_date", "publication_date"), F.lit(30))
    ratio = F.when(priced, F.try_divide(act, est)).otherwise(1.0)
    flagged, worst, amended = F.coalesce("flags", F.lit(0)), F.coalesce("worst", F.lit(0.0)), F.coalesce("amendment_count", F.lit(0))
    zero = F.lit(0.0)  # the set knows no single bids
    made = {
        "has_winner": F.coalesce(F.col("winner") != "", F.lit(False)).cast("int"), "num_bidders": n, "single_bidder": (n == 1).cast("int"), "bidder_count": n, "estimated_value_mkd": est, "actual_value_mkd": act, "has_price_data": ((est > 0) | (act > 0)).cast("int"),
        "price_deviation": F.round(F.when(priced, F.abs(ratio - 1)).otherwise(0.0), 6), "price_ratio": F.round(ratio, 6), "bid_mean": F.when(act > 0, act).otherwise(est), "bid_std": zero, "bid_cv": zero, "deadline_days": days, "short_deadline": (days < 15).cast("int"),
        "num_documents": F.coalesce("docs", F.lit(0)), "amendment_count": amended, "has_amendments": (amended > 0).cast("int"), "flag_count": flagged, "max_flag_score": worst, "avg_flag_score": F.when(flagged > 0, worst).otherwise(0.0),
    }
    return t.select("tender_id", *[c.alias(name) for name, c in made.items()])


def _habit_of_pairs(bids: DataFrame) -> DataFrame:
    """(tender_id, habit): the mean over a tender's pairs of bidders of the share of the rarer bidder's tenders at which both bid.

    The pairs are those within one tender, as many as the measure has terms; each pair of companies is counted once.
    """
    totals = materialize(bids.groupBy("company_name").agg(F.count(F.lit(1)).alias("total")), "bid-totals")
    a, b = bids.select("tender_id", F.col("company_name").alias("a")), bids.select("tender_id", F.col("company_name").alias("b"))
    pairs = materialize(a.join(b, "tender_id").filter("a < b"), "bid-pairs")
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    total = lambda c: totals.select(F.col("company_name").alias(c), F.col("total").alias(f"{c}_total"))
    shares = materialize(met.join(total("a"), "a").join(total("b"), "b").select("a", "b", (F.col("met") / F.least("a_total", "b_total")).alias("share")), "pair-shares")
    return pairs.join(shares, ["a", "b"]).groupBy("tender_id").agg(F.avg("share").alias("habit"))


def _newcomers(bids: DataFrame, tenders: DataFrame) -> DataFrame:
    """(tender_id, newcomers): bidders that had not bid at the buyer on any earlier day; tenders without buyer or date have none."""
    dated = materialize(bids.join(tenders.select("tender_id", "procuring_entity", "publication_date").filter("procuring_entity is not null and publication_date is not null"), "tender_id"), "dated-bids")
    first = materialize(dated.groupBy("procuring_entity", "company_name").agg(F.min("publication_date").alias("first")), "first-bids")
    new = dated.join(first, ["procuring_entity", "company_name"]).filter(F.col("publication_date") == F.col("first"))
    return new.groupBy("tender_id").agg(F.count(F.lit(1)).alias("newcomers"))


def competition_feature_set(tenders: DataFrame, bidders: DataFrame, *, digits: int = 6) -> DataFrame:
    """(tender_id, 14 numbers): how many bid, against the means of the buyer and the category, who was disqualified, where the winner
    stood, how concentrated the bids are (0 to 10000), who is new to the buyer, and how often these bidders meet.

    Tenders without bids have 0 throughout.  Means are those of awarded and closed tenders that had bidders.
    """
    bids = bidders.filter(F.col("company_name").isNotNull()).select("tender_id", "company_name").distinct()
    v, won = F.coalesce("bid_amount_mkd", F.lit(0.0)), F.coalesce("is_winner", F.lit(False))
    per = bidders.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("disqualified", F.lit(False))).alias("out"), F.sum(v).alias("v"), F.sum(v * v).alias("vv"), F.min(F.when(won, F.col("rank"))).alias("winner_at")
    )
    had = tenders.filter((F.col("num_bidders") > 0) & F.col("status").isin("awarded", "closed"))
    mean = lambda key, name: materialize(had.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg("num_bidders").alias(name)), name)
    t = tenders.select("tender_id", "procuring_entity", "category", "winner").join(mean("procuring_entity", "buyer_mean"), "procuring_entity", "left").join(mean("category", "category_mean"), "category", "left")
    t = t.join(per, "tender_id", "left").join(_newcomers(bids, tenders), "tender_id", "left").join(_habit_of_pairs(bids), "tender_id", "left")
    n, at = F.coalesce("n", F.lit(0)), F.when(F.col("winner").isNotNull(), F.col("winner_at"))
    zero = lambda value: F.coalesce(value, F.lit(0)).cast("double")
    made = {
        "num_bidders": n, "single_bidder": _flag(n == 1), "no_bidders": _flag(n == 0), "two_bidders": _flag(n == 2),
        "bidders_vs_institution_avg": F.try_divide(n, F.col("buyer_mean")), "bidders_vs_category_avg": F.try_divide(n, F.col("category_mean")),
        "num_disqualified": F.col("out"), "disqualification_rate": F.try_divide("out", "n"), "winner_rank": at, "winner_not_lowest": _flag(at > 1),
        "market_concentration_hhi": F.try_divide(F.col("vv") * 10000, F.col("v") * F.col("v")), "new_bidders_count": F.col("newcomers"), "new_bidders_ratio": F.try_divide("newcomers", "n"),
        "bidder_clustering_score": F.col("habit"),
    }
    return t.select("tender_id", *[F.round(zero(c), digits).alias(name) for name, c in made.items()])
