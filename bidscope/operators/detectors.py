"""Red-flag detectors: each a set-based transformation over all tenders.

A detector takes tenders and bidders and returns flags: (tender_id, flag_type, severity, score, evidence, description),
evidence being JSON.  Thresholds are keyword arguments.  Where the order of awards matters, ties on the publication date
are broken by tender_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.workspace import materialize

AWARDED = ("awarded", "completed")
FLAG_COLUMNS = ("tender_id", "flag_type", "severity", "score", "evidence", "description")

#: Reliability weight of each flag type in the risk index.
WEIGHTS = {
    "single_bidder": 1.0,
    "procedure_type": 1.2,
    "contract_splitting": 1.3,
    "identical_bids": 1.5,
    "strategic_disqualification": 1.4,
    "bid_rotation": 1.2,
    "professional_loser": 0.8,
    "short_deadline": 0.9,
    "short_decision": 1.0,
    "contract_value_growth": 1.0,
    "late_amendment": 0.9,
    "threshold_manipulation": 0.8,
    "repeat_winner": 1.1,
    "price_anomaly": 1.1,
    "bid_clustering": 1.2,
}


def points(*parts: tuple[Column | bool, int], base: int = 0) -> Column:
    """base plus the points of the conditions that hold, 100 at most; an unknown condition adds nothing."""
    total = F.lit(base)
    for condition, n in parts:
        total = total + F.when(condition, n).otherwise(0)
    return F.least(total, F.lit(100)).cast("int")


def banded(score: Column | str, *steps: tuple[int, str], other: str) -> Column:
    """The name of the first step that the score reaches, steps from high to low."""
    score = F.col(score) if isinstance(score, str) else score
    out = F.lit(other)
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def as_flags(df: DataFrame, flag_type: str, score: Column, severity: Column, evidence: list[str], description: Column) -> DataFrame:
    scored = df.withColumn("__score", score)
    return scored.select("tender_id", F.lit(flag_type).alias("flag_type"), severity.alias("severity"), F.col("__score").alias("score"), F.to_json(F.struct(*evidence)).alias("evidence"), description.alias("description"))


#: The column that severities are read from.
S = "__score"


def won(tenders: DataFrame, statuses: tuple[str, ...] = AWARDED) -> DataFrame:
    return tenders.filter(F.col("status").isin(*statuses) & F.col("winner").isNotNull() & (F.col("winner") != ""))


def single_bidder(tenders: DataFrame, *, least_value: float = 500_000, high_value: float = 5_000_000, repeat_wins: int = 3) -> DataFrame:
    """One bid on a tender of some value; worse if large, or if the winner has won at this buyer before."""
    w = Window.partitionBy("procuring_entity", "winner").orderBy("publication_date", "tender_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = won(tenders).withColumn("previous_wins", F.count(F.lit(1)).over(w)).filter((F.col("num_bidders") == 1) & (F.col("estimated_value_mkd") > least_value))
    score = points((F.col("estimated_value_mkd") > high_value, 20), (F.col("previous_wins") >= repeat_wins, 20), base=40)
    return as_flags(rows, "single_bidder", score, banded(S, (70, "critical"), (60, "high"), (45, "medium"), other="low"), ["num_bidders", "estimated_value_mkd", "winner", "procuring_entity", "previous_wins"], F.format_string("one bid on a tender of %.0f", "estimated_value_mkd"))


def repeat_winner(tenders: DataFrame, *, least_wins: int = 5, least_share: float = 60.0, many_wins: int = 10) -> DataFrame:
    """A company that holds most awards of a buyer; flagged on its latest award there."""
    own = won(tenders)
    pairs = own.groupBy("procuring_entity", "winner").agg(F.count(F.lit(1)).alias("wins"), F.sum("estimated_value_mkd").alias("total_value_mkd"), F.max(F.struct("publication_date", "tender_id")).alias("last"))
    buyers = own.groupBy("procuring_entity").agg(F.count(F.lit(1)).alias("awards"))
    share = F.col("wins") * 100.0 / F.col("awards")
    rows = pairs.filter(F.col("wins") >= least_wins).join(buyers, "procuring_entity").withColumn("share", share).filter(F.col("share") > least_share).withColumn("tender_id", F.col("last.tender_id"))
    score = F.least(F.lit(100), F.lit(50) + (F.floor((F.col("share") - 60) / 10) * 10).cast("int") + F.when(F.col("wins") > many_wins, 20).otherwise(0)).cast("int")
    return as_flags(rows, "repeat_winner", score, banded(S, (80, "critical"), (70, "high"), (60, "medium"), other="low"), ["winner", "procuring_entity", "wins", "share", "total_value_mkd"], F.format_string("%s holds %.1f%% of the awards of %s", "winner", "share", "procuring_entity"))


def price_anomaly(tenders: DataFrame, bidders: DataFrame, *, least_bids: int = 3, low_cov: float = 0.05, high_z: float = 2.0, near_estimate: float = 0.01) -> DataFrame:
    """Bids too close together, a winner far below the rest, or a winner at the estimate."""
    stats = bidders.filter("bid_amount_mkd > 0").groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("num_bids"), F.avg("bid_amount_mkd").alias("avg_bid"), F.stddev_samp("bid_amount_mkd").alias("sd_bid"), F.max(F.when(F.col("is_winner"), F.col("bid_amount_mkd"))).alias("winner_bid")
    )
    rows = stats.filter(F.col("num_bids") >= least_bids).join(tenders.filter(F.col("estimated_value_mkd") > 0), "tender_id")
    cov, z = F.try_divide("sd_bid", "avg_bid"), (F.col("avg_bid") - F.col("winner_bid")) / F.nullif("sd_bid", F.lit(0.0))
    off = F.abs(F.col("winner_bid") - F.col("estimated_value_mkd")) / F.col("estimated_value_mkd")
    rows = rows.withColumns({"close": (cov > 0) & (cov < low_cov), "low": z > high_z, "exact": off < near_estimate}).filter("close or low or exact")
    score = points((F.col("close"), 25), (F.col("low"), 20), (F.col("exact"), 15), base=45)
    return as_flags(rows, "price_anomaly", score, banded(S, (80, "critical"), (65, "high"), (50, "medium"), other="low"), ["num_bids", "avg_bid", "sd_bid", "winner_bid", "close", "low", "exact"], F.lit("unusual prices"))


def _bids_of_many(bidders: DataFrame, least_together: int) -> DataFrame:
    """(tender_id, company_name, won) of companies with ``least_together`` tenders or more."""
    one = bidders.groupBy("tender_id", "company_name").agg(F.max("is_winner").alias("won"))
    if least_together > 1:
        one = one.join(one.groupBy("company_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_together).select("company_name"), "company_name", "left_semi")
    return one


def co_bidding_pairs(bidders: DataFrame, *, least_together: int = 1) -> DataFrame:
    """(company_a, company_b, together, a_wins, b_wins) of companies that bid on the same tenders.

    Companies with fewer than ``least_together`` tenders can't reach it and leave before the self-join.
    """
    one = _bids_of_many(bidders, least_together)
    a, b = one.select("tender_id", F.col("company_name").alias("company_a"), F.col("won").alias("a_won")), one.select("tender_id", F.col("company_name").alias("company_b"), F.col("won").alias("b_won"))
    pairs = a.join(b, "tender_id").filter("company_a < company_b")
    return pairs.groupBy("company_a", "company_b").agg(F.count(F.lit(1)).alias("together"), F.count_if("a_won").alias("a_wins"), F.count_if("b_won").alias("b_wins")).filter(F.col("together") >= least_together)


def clustered_pairs(bidders: DataFrame, *, least_together: int = 5, least_overlap: float = 70.0) -> DataFrame:
    """Pairs that bid together in most of the smaller one's tenders."""
    totals = bidders.groupBy("company_name").agg(F.count_distinct("tender_id").alias("bids"))
    a, b = totals.select(F.col("company_name").alias("company_a"), F.col("bids").alias("a_bids")), totals.select(F.col("company_name").alias("company_b"), F.col("bids").alias("b_bids"))
    pairs = co_bidding_pairs(bidders, least_together=least_together).join(a, "company_a").join(b, "company_b")
    overlap = F.col("together") * 100.0 / F.least("a_bids", "b_bids")
    return pairs.withColumns({"overlap": overlap, "dominant": F.greatest("a_wins", "b_wins") * 100.0 / F.col("together")}).filter(F.col("overlap") > least_overlap)


def with_latest(pairs: DataFrame, tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Add ``last``, the latest (publication_date, tender_id) that both companies of a pair bid on; only companies of these pairs are read for it."""
    pairs = pairs if pairs.__dict__.get("_bidscope_path") else materialize(pairs, "clustered-pairs")
    named = pairs.select(F.explode(F.array("company_a", "company_b")).alias("company_name")).distinct()
    one = bidders.join(named, "company_name", "left_semi").select("tender_id", "company_name").distinct()
    a, b = (one.select("tender_id", F.col("company_name").alias(c)) for c in ("company_a", "company_b"))
    both = a.join(pairs.select("company_a", "company_b"), "company_a").join(b, ["tender_id", "company_b"])
    last = both.join(tenders.select("tender_id", "publication_date"), "tender_id").groupBy("company_a", "company_b").agg(F.max(F.struct("publication_date", "tender_id")).alias("last"))
    return pairs.join(last, ["company_a", "company_b"])


def bid_clustering(tenders: DataFrame, bidders: DataFrame, *, least_together: int = 5, least_overlap: float = 70.0, pairs: DataFrame | None = None) -> DataFrame:
    """A clustered pair; flagged on the latest tender both bid on.  ``pairs`` are those of ``clustered_pairs``, if made before."""
    pairs = clustered_pairs(bidders, least_together=least_together, least_overlap=least_overlap) if pairs is None else pairs
    last = with_latest(pairs, tenders, bidders).withColumn("tender_id", F.col("last.tender_id"))
    score = points((F.col("dominant") > 80, 20), base=60)
    return as_flags(last, "bid_clustering", score, banded(S, (75, "critical"), (65, "high"), other="medium"), ["company_a", "company_b", "together", "overlap", "dominant"], F.format_string("%s and %s bid together", "company_a", "company_b"))


def short_deadline(tenders: DataFrame, *, p25_days: int = 7, p10_days: int = 6, least_value: float = 500_000) -> DataFrame:
    """Fewer days from publication to closing than nearly all tenders have."""
    days = F.datediff("closing_date", "publication_date")
    rows = tenders.withColumn("days", days).filter((F.col("days") < p25_days) & (F.col("estimated_value_mkd") > least_value) & F.col("status").isin("awarded", "closed", "completed"))
    score = points((F.col("days") < p10_days, 25), (F.col("days") < 3, 30), (F.col("num_bidders") == 1, 20), base=35)
    severity = F.when((F.col("days") < 3) | (F.col(S) >= 80), "critical").when((F.col("days") < p10_days) | (F.col(S) >= 60), "high").when(F.col(S) >= 45, "medium").otherwise("low")
    return as_flags(rows, "short_deadline", score, severity, ["publication_date", "closing_date", "days", "estimated_value_mkd", "num_bidders"], F.format_string("open for %d days", "days"))


#: Procedure types without open competition -> (score, severity); low-value ones count only above the value floor.
PROCEDURE_RISK = {
    "NegotiatedProcedureWithoutPriorPublication": (60, "high"),
    "ProcedureForTalkingWithPreviousAnnouncement": (60, "high"),
    "LowEstimatedValueProcedure": (45, "medium"),
    "QualificationSystem": (35, "medium"),
    "BidForChoosingIdealSolution": (30, "low"),
}


def procedure_type(tenders: DataFrame, *, least_value: float = 500_000) -> DataFrame:
    """Awards by procedures that limit competition."""
    kind = F.trim("procedure_type")
    rows = tenders.filter(F.col("status").isin(*AWARDED) & kind.isin(*PROCEDURE_RISK)).withColumn("kind", kind)
    rows = rows.filter((F.col("kind") != "LowEstimatedValueProcedure") | (F.col("estimated_value_mkd") > least_value))
    score = F.coalesce(*[F.when(F.col("kind") == k, v[0]) for k, v in PROCEDURE_RISK.items()])
    severity = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[1])) for k, v in PROCEDURE_RISK.items()])
    return as_flags(rows, "procedure_type", score, severity, ["procedure_type", "kind", "estimated_value_mkd", "num_bidders", "winner", "procuring_entity"], F.concat(F.lit("awarded by "), "kind"))


def identical_bids(tenders: DataFrame, bidders: DataFrame, *, near_estimate: float = 0.01) -> DataFrame:
    """Several companies with the same amount on one tender."""
    same = bidders.filter("bid_amount_mkd > 0").groupBy("tender_id", "bid_amount_mkd").agg(F.sort_array(F.collect_set("company_name")).alias("names")).withColumn("companies", F.size("names").cast("long")).filter("companies > 1")
    rows = same.join(tenders.select("tender_id", "estimated_value_mkd", "winner"), "tender_id")
    exact = (F.col("estimated_value_mkd") > 0) & (F.abs(F.col("bid_amount_mkd") - F.col("estimated_value_mkd")) / F.nullif("estimated_value_mkd", F.lit(0.0)) < near_estimate)
    return as_flags(rows, "identical_bids", points((exact, 15), base=75), banded(S, (85, "critical"), other="high"), ["bid_amount_mkd", "names", "companies", "estimated_value_mkd", "winner"], F.format_string("%d companies bid %.0f", "companies", "bid_amount_mkd"))


def professional_loser(tenders: DataFrame, bidders: DataFrame, *, least_bids: int = 10, most_win_rate: float = 0.05, least_together: int = 5, least_overlap: float = 70.0, pairs: DataFrame | None = None) -> DataFrame:
    """Companies that bid often and hardly ever win; worse beside a winner they are clustered with (of ``pairs``, if made before)."""
    stats = bidders.groupBy("company_name").agg(F.count(F.lit(1)).alias("bids"), F.count_if("is_winner").alias("wins")).filter((F.col("bids") >= least_bids) & (F.col("wins") / F.col("bids") < most_win_rate))
    losses = bidders.filter("not is_winner").select("tender_id", "company_name").distinct().join(stats, "company_name").join(won(tenders).select("tender_id", "winner", "procuring_entity"), "tender_id")
    pairs = (clustered_pairs(bidders, least_together=least_together, least_overlap=least_overlap) if pairs is None else pairs).select("company_a", "company_b")
    both = pairs.union(pairs.select("company_b", "company_a")).select(F.col("company_a").alias("company_name"), F.col("company_b").alias("winner"), F.lit(True).alias("clustered"))
    rows = losses.join(both, ["company_name", "winner"], "left").withColumn("clustered", F.coalesce("clustered", F.lit(False)))
    return as_flags(rows, "professional_loser", points((F.col("clustered"), 20), base=40), banded(S, (55, "high"), other="medium"), ["company_name", "bids", "wins", "winner", "clustered"], F.concat(F.col("company_name"), F.lit(" hardly ever wins")))


def contract_splitting(tenders: DataFrame, *, least_contracts: int = 3, cap: float = 1_000_000, least_sum: float = 1_000_000, high_value: float = 800_000, many: int = 5) -> DataFrame:
    """Several contracts of one buyer and winner in a quarter, each below the cap, together above it; each is flagged."""
    own = won(tenders).filter("estimated_value_mkd > 0 and publication_date is not null").withColumn("quarter", F.date_trunc("quarter", "publication_date").cast("date"))
    w = Window.partitionBy("procuring_entity", "winner", "quarter")
    sums = {"contracts": F.count(F.lit(1)).over(w), "max_value": F.max("estimated_value_mkd").over(w), "total_value": F.sum("estimated_value_mkd").over(w)}
    rows = own.withColumns(sums).filter((F.col("contracts") >= least_contracts) & (F.col("max_value") < cap) & (F.col("total_value") > least_sum))
    score = points((F.col("max_value") > high_value, 15), (F.col("contracts") >= many, 10), base=65)
    return as_flags(rows, "contract_splitting", score, banded(S, (80, "critical"), other="high"), ["procuring_entity", "winner", "quarter", "contracts", "max_value", "total_value"], F.format_string("%d contracts in one quarter", "contracts"))


def short_decision(tenders: DataFrame, *, most_days: int = 3) -> DataFrame:
    """Signed within days of closing."""
    rows = tenders.withColumn("days", F.datediff("contract_signing_date", "closing_date")).filter(F.col("days").between(0, most_days - 1) & F.col("status").isin(*AWARDED))
    score = points((F.col("days") <= 1, 20), (F.col("num_bidders") == 1, 15), base=45)
    return as_flags(rows, "short_decision", score, banded(S, (75, "critical"), (60, "high"), other="medium"), ["closing_date", "contract_signing_date", "days", "num_bidders", "winner"], F.format_string("decided in %d days", "days"))


def strategic_disqualification(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """All but the winners disqualified, or the lowest bid disqualified where only the price counts."""
    t = tenders.filter(F.col("status").isin(*AWARDED)).select("tender_id", "winner", "procuring_entity", "estimated_value_mkd", "evaluation_method")
    sums = bidders.groupBy("tender_id").agg(F.count(F.lit(1)).alias("bids"), F.count_if("disqualified").alias("disqualified"), F.count_if("is_winner").alias("winners"))
    all_but = sums.filter("disqualified >= 2 and disqualified = bids - winners").join(t, "tender_id").withColumn("rule", F.lit("R035"))
    lowest = bidders.filter("bid_amount_mkd > 0").withColumn("n", F.row_number().over(Window.partitionBy("tender_id").orderBy("bid_amount_mkd", "company_name"))).filter("n = 1 and disqualified")
    by_price = F.lower("evaluation_method").rlike("najniska cena|lowest|цена|најниска")
    low = lowest.join(t.filter(by_price), "tender_id").withColumn("rule", F.lit("R036"))
    made = lambda df, score, severity: as_flags(df, "strategic_disqualification", F.lit(score), F.lit(severity), ["rule", "winner", "procuring_entity", "estimated_value_mkd"], F.concat(F.lit("disqualification by rule "), "rule"))
    return made(all_but, 70, "high").unionByName(made(low, 55, "medium"))


def contract_value_growth(tenders: DataFrame, *, least_ratio: float = 1.2) -> DataFrame:
    """Contracts well above their estimate."""
    rows = tenders.filter((F.col("estimated_value_mkd") > 0) & (F.col("actual_value_mkd") > F.col("estimated_value_mkd") * least_ratio) & F.col("status").isin(*AWARDED))
    rows = rows.withColumn("overrun", (F.col("actual_value_mkd") / F.col("estimated_value_mkd") - 1) * 100)
    score = F.least(F.lit(100), F.lit(40) + F.least(F.lit(40), F.floor(F.col("overrun") / 5).cast("int")) + F.when(F.col("amendment_count") > 0, 10).otherwise(0)).cast("int")
    return as_flags(rows, "contract_value_growth", score, banded(S, (75, "critical"), (60, "high"), (45, "medium"), other="low"), ["estimated_value_mkd", "actual_value_mkd", "overrun", "amendment_count", "winner"], F.format_string("%.1f%% above the estimate", "overrun"))


def bid_rotation(tenders: DataFrame, *, least_awards: int = 10, winners: tuple[int, int] = (2, 5), high_value: float = 10_000_000) -> DataFrame:
    """A buyer whose awards go round a few companies; flagged on its latest award.  Awards alternate if over six in ten go to the
    company that their place in a round of two or of three names, as the first round has it."""
    own = won(tenders).filter("publication_date is not null").select("procuring_entity", "tender_id", "winner", "publication_date", "estimated_value_mkd")
    seq = own.withColumn("seq", F.row_number().over(Window.partitionBy("procuring_entity").orderBy("publication_date", "tender_id")))
    first = lambda k: F.max(F.when(F.col("seq") == k, F.col("winner"))).alias(f"first{k}")
    few = own.groupBy("procuring_entity").agg(F.count(F.lit(1)).alias("awards"), F.count_distinct("winner").alias("n_winners"), F.sum("estimated_value_mkd").alias("total_value"), F.max_by("tender_id", F.struct("publication_date", "tender_id")).alias("tender_id"))
    few = few.filter((F.col("awards") >= least_awards) & F.col("n_winners").between(*winners))
    heads = seq.filter("seq <= 3").groupBy("procuring_entity").agg(first(1), first(2), first(3)).join(few.select("procuring_entity"), "procuring_entity", "left_semi")
    turn = lambda n: F.element_at(F.array(*[F.col(f"first{k}") for k in range(1, n + 1)]), ((F.col("seq") - 1) % n + 1).cast("int"))
    hits = seq.join(heads, "procuring_entity").groupBy("procuring_entity").agg(*[F.count_if(F.col("winner") == turn(n)).alias(f"hits{n}") for n in (2, 3)])
    repeats = lambda n: (F.col("awards") >= 3 * n) & (F.col(f"hits{n}") / F.col("awards") > 0.6)
    rows = few.join(hits, "procuring_entity").withColumn("alternates", (F.col("awards") >= 6) & (repeats(2) | repeats(3)))
    score = points((F.col("alternates"), 20), (F.col("total_value") > high_value, 15), base=55)
    return as_flags(rows, "bid_rotation", score, banded(S, (75, "critical"), (65, "high"), other="medium"), ["procuring_entity", "n_winners", "awards", "total_value", "alternates"], F.format_string("%d companies share %d awards", "n_winners", "awards"))


THRESHOLDS = (500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000, 20_000_000)


def threshold_manipulation(tenders: DataFrame, *, thresholds: tuple[int, ...] = THRESHOLDS, band: float = 0.95, repeats: int = 3) -> DataFrame:
    """Estimates just below a threshold."""
    value = F.col("estimated_value_mkd")
    near = F.coalesce(*[F.when((value >= t * band) & (value < t), t) for t in thresholds])
    rows = tenders.filter(F.col("status").isin("awarded", "completed", "active", "closed")).withColumn("threshold", near).filter("threshold is not null")
    rows = rows.withColumn("at_threshold", F.count(F.lit(1)).over(Window.partitionBy("procuring_entity", "threshold")))
    alone = F.coalesce(F.col("num_bidders") == 1, F.lit(False)) | F.coalesce(F.col("procedure_type").contains("Negotiated") | F.col("procedure_type").contains("Преговарачка"), F.lit(False))
    score = points((F.col("at_threshold") >= repeats, 15), (alone, 20), base=35)
    return as_flags(rows, "threshold_manipulation", score, banded(S, (65, "high"), (50, "medium"), other="low"), ["estimated_value_mkd", "threshold", "at_threshold", "num_bidders", "procedure_type"], F.format_string("just below %d", "threshold"))


def late_amendment(tenders: DataFrame, *, most_days: int = 3) -> DataFrame:
    """Changed shortly before closing, or after it."""
    rows = tenders.withColumn("days", F.datediff("closing_date", "last_amendment_date")).filter((F.col("amendment_count") > 0) & (F.col("days") <= most_days) & F.col("status").isin("awarded", "completed", "active", "closed"))
    score = points((F.col("days") < 0, 25), (F.col("num_bidders") == 1, 15), base=45)
    return as_flags(rows, "late_amendment", score, banded(S, (75, "critical"), (60, "high"), other="medium"), ["amendment_count", "last_amendment_date", "closing_date", "days", "num_bidders"], F.format_string("changed %d days before closing", "days"))


def all_flags(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """The flags of all detectors with their default thresholds; the pairs that two of them read are made once."""
    pairs = materialize(clustered_pairs(bidders), "clustered-pairs")
    parts = [
        single_bidder(tenders), repeat_winner(tenders), price_anomaly(tenders, bidders), bid_clustering(tenders, bidders, pairs=pairs), short_deadline(tenders), procedure_type(tenders), identical_bids(tenders, bidders),
        professional_loser(tenders, bidders, pairs=pairs), contract_splitting(tenders), short_decision(tenders), strategic_disqualification(tenders, bidders), contract_value_growth(tenders), bid_rotation(tenders), threshold_manipulation(tenders), late_amendment(tenders),
    ]
    return reduce(DataFrame.unionByName, parts)


def weight_of(flag_type: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return F.coalesce(*[F.when(flag_type == k, F.lit(v)) for k, v in weights.items()], F.lit(1.0))


def risk_index(flags: DataFrame, *, bonus: int = 8, weights: dict[str, float] = WEIGHTS, rounding: str = "trunc") -> DataFrame:
    """(tender_id, cri, risk_level, flag_types): weighted mean of each type's highest score, and a bonus for each further type."""
    per_type = flags.groupBy("tender_id", "flag_type").agg(F.max("score").alias("score")).withColumn("w", weight_of(F.col("flag_type"), weights))
    sums = per_type.groupBy("tender_id").agg(F.sum(F.col("score") * F.col("w")).alias("sw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("flag_types"))
    # Sums of weights in tenths differ in their last bit with the order of adding; rounding to ten places settles them.
    raw = F.round(F.col("sw") / F.col("w"), 10) + bonus * (F.col("flag_types") - 1)
    cri = F.least(F.lit(100), (F.floor(raw) if rounding == "trunc" else F.bround(raw)).cast("int")).cast("int")
    return sums.select("tender_id", cri.alias("cri"), "flag_types").withColumn("risk_level", banded(F.col("cri"), (80, "critical"), (60, "high"), (40, "medium"), (20, "low"), other="minimal"))


def flagged_rollup(flags: DataFrame, tenders: DataFrame) -> DataFrame:
    """One row per flagged tender: number of flags, types, worst severity, highest score, and its risk index."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for n, s in ((4, "critical"), (3, "high"), (2, "medium"), (1, "low"))])
    per = flags.groupBy("tender_id").agg(F.count(F.lit(1)).alias("total_flags"), F.max(rank).alias("severity_rank"), F.max("score").alias("max_score"), F.array_join(F.sort_array(F.collect_set("flag_type")), ",").alias("types"))
    return per.join(risk_index(flags), "tender_id").join(tenders.select("tender_id", "procuring_entity", "winner", "estimated_value_mkd", "status"), "tender_id")
