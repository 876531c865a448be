"""What was known of a tender's parties before it was published, and where a buyer's risk is heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relationship_features(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per tender its winner's record with the buyer and overall, and the buyer's own, strictly before publication.

    Only awarded and closed tenders count.  A win weighs as many rows as its tender has bidders, one at least, so shares are of
    bidder rows.  Facts are summed per key and day before the windows read them; a key's window has a row for each day.
    """
    day = F.col("publication_date")
    size = bidders.groupBy("tender_id").agg(F.count(F.lit(1)).alias("__n"))
    t = tenders.filter("status in ('awarded', 'closed')").join(size, "tender_id", "left").select("tender_id", F.col("procuring_entity").alias("buyer"), F.col("winner").alias("company"), day.alias("day"), "num_bidders", F.greatest(F.coalesce("__n", F.lit(1)), F.lit(1)).alias("rows"))
    probes = tenders.select("tender_id", F.col("procuring_entity").alias("buyer"), F.col("winner").alias("company"), day.alias("day"))
    wins = t.filter("company is not null").select("company", "buyer", "day", F.col("rows").alias("wins"), F.lit(0).alias("bids"))
    bids = bidders.select("tender_id", F.col("company_name").alias("bidder")).join(t, "tender_id").select(F.col("bidder").alias("company"), "buyer", "day", F.lit(0).alias("wins"), F.lit(1).alias("bids"))
    facts = wins.unionByName(bids).withColumn("institutions", F.lit(0))
    first = wins.groupBy("company", "buyer").agg(F.min("day").alias("day")).select("company", "buyer", "day", F.lit(0).alias("wins"), F.lit(0).alias("bids"), F.lit(1).alias("institutions"))
    n = F.when(F.col("num_bidders") > 0, F.col("num_bidders"))
    own = t.select("buyer", "day", "rows", F.when(n.isNotNull(), 1).otherwise(0).alias("counted"), F.when(n == 1, 1).otherwise(0).alias("single"), F.coalesce(n, F.lit(0)).alias("offers"))

    def before(rows: DataFrame, keys: list[str], sums: list[str], prefix: str) -> DataFrame:
        asked = probes.select(*keys, "day", *[F.lit(0).alias(s) for s in sums])
        daily = rows.select(*keys, "day", *sums).unionByName(asked).groupBy(*keys, "day").agg(*[F.sum(s).alias(s) for s in sums])
        earlier = Window.partitionBy(*keys).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
        return daily.select(*keys, "day", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(prefix + s) for s in sums])

    pair = before(facts, ["company", "buyer"], ["wins", "bids"], "pair_")
    overall = before(facts.unionByName(first), ["company"], ["wins", "bids", "institutions"], "total_")
    buyer = before(own, ["buyer"], ["rows", "counted", "single", "offers"], "buyer_")
    j = probes.join(buyer, ["buyer", "day"], "left").join(pair, ["company", "buyer", "day"], "left").join(overall, ["company", "day"], "left")
    named = F.col("company").isNotNull()
    count = lambda c: F.when(named, F.col(c)).otherwise(0)
    share = lambda a, b: F.round(F.when(named & (F.col(b) > 0), F.col(a) / F.col(b)).otherwise(0.0), 6)
    of_buyer = lambda c: F.round(F.coalesce(F.try_divide(c, "buyer_counted"), F.lit(0.0)), 6)
    return j.select(
        "tender_id", count("pair_wins").alias("pair_wins"), count("pair_bids").alias("pair_bids"), share("pair_wins", "pair_bids").alias("pair_win_rate"), share("pair_wins", "buyer_rows").alias("market_share"),
        count("total_wins").alias("total_wins"), count("total_bids").alias("total_bids"), share("total_wins", "total_bids").alias("win_rate"), count("total_institutions").alias("institutions"),
        (named & (F.col("total_bids") <= 1)).cast("int").alias("new_supplier"), (named & (F.col("total_bids") >= 10)).cast("int").alias("experienced"),
        F.coalesce("buyer_counted", F.lit(0)).alias("buyer_tenders"), of_buyer("buyer_single").alias("buyer_single_rate"), of_buyer("buyer_offers").alias("buyer_mean_bidders"),
    )


def trajectories(profiles: DataFrame, *, steep: float = 0.5, restless: float = 20.0, calm: float = 10.0, high: float = 60.0, low: float = 30.0) -> DataFrame:
    """(procuring_entity, trajectory, confidence) of temporal profiles; the first rule that holds decides.  Unknown means count as zero."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    slope, spread, month, quarter, year = (z(c) for c in ("slope", "volatility", "mean_30d", "mean_90d", "mean_365d"))
    rules: list[tuple[Column, str, Column]] = [
        ((slope > steep) & (month > year), "escalating", F.least(F.lit(0.95), 0.5 + F.abs(slope) / 5 + (month - year) / 100)),
        (spread > restless, "volatile", F.least(F.lit(0.85), 0.4 + spread / 50)),
        ((quarter > high) & (spread < calm), "stable_high", F.least(F.lit(0.9), 0.6 + quarter / 200)),
        (slope < -steep, "declining", F.least(F.lit(0.9), 0.5 + F.abs(slope) / 5)),
        ((quarter < low) & (spread < calm), "stable_low", F.least(F.lit(0.9), 0.7 + (low - quarter) / 100)),
        (F.lit(True), "moderate", F.lit(0.5)),
    ]
    found = F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("trajectory"), F.round(v, 3).alias("confidence"))) for c, n, v in rules])
    return profiles.select("procuring_entity", found.alias("r")).select("procuring_entity", "r.trajectory", "r.confidence")
