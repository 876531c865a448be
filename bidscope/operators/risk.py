"""Statistics over flags, alternative risk scores, alerts, feature tables and temporal profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.cleaning import search_variants
from bidscope.operators.detectors import AWARDED, WEIGHTS, banded, risk_index


def row_count() -> Column:
    return F.count(F.lit(1))


SEVERITY = (("critical", 4), ("high", 3), ("medium", 2), ("low", 1))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, n) for s, n in SEVERITY])


def flag_type_counts(flags: DataFrame) -> DataFrame:
    """Flags per type, types without any included."""
    kinds = flags.sparkSession.createDataFrame([(k,) for k in WEIGHTS], "flag_type string")
    counts = flags.groupBy("flag_type").agg(row_count().alias("flags"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return F.broadcast(kinds).join(counts, "flag_type", "left").fillna(0, ["flags", "critical"])


def average_score(flags: DataFrame) -> DataFrame:
    """Rounded plain average of a tender's flag scores."""
    score = F.round(F.avg("score"))
    return flags.groupBy("tender_id").agg(score.cast("int").alias("risk_score"), row_count().alias("flag_count")).withColumn("risk_level", banded(F.col("risk_score"), (80, "critical"), (60, "high"), (40, "medium"), (20, "low"), other="minimal"))


def full_coverage_score(flags: DataFrame, tenders: DataFrame) -> DataFrame:
    """A score for every award, flagged or not."""
    per = flags.groupBy("tender_id").agg(F.avg("score").alias("mean"), row_count().alias("n"))
    plain = F.when(F.col("num_bidders") == 1, 25.0).when(F.col("num_bidders") == 2, 10.0).otherwise(5.0)
    rows = tenders.filter(F.col("status").isin(*AWARDED)).select("tender_id", "num_bidders").join(per, "tender_id", "left")
    score = F.when(F.col("n").isNull(), plain).otherwise(F.least(F.lit(100.0), F.col("mean") * (1 + 0.15 * (F.col("n") - 1))))
    return rows.select("tender_id", F.round(score, 4).alias("score"), F.coalesce("n", F.lit(0)).alias("flags"))


def institution_risk(flags: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per buyer: share of flagged tenders and mean index."""
    cri = risk_index(flags)
    return tenders.join(cri, "tender_id", "left").groupBy("procuring_entity").agg(row_count().alias("tenders"), F.count("cri").alias("flagged"), F.round(F.count("cri") * 100.0 / row_count(), 4).alias("flagged_share"), F.round(F.avg("cri"), 4).alias("mean_cri"), F.max("cri").alias("max_cri"))


def suspicious_companies(flags: DataFrame, tenders: DataFrame, least: int = 3) -> DataFrame:
    per = flags.join(tenders.filter("winner is not null").select("tender_id", "winner"), "tender_id")
    return per.groupBy("winner").agg(row_count().alias("flags"), F.count_distinct("tender_id").alias("tenders"), F.round(F.avg("score"), 4).alias("mean_score"), F.max(severity_rank(F.col("severity"))).alias("worst")).filter(F.col("tenders") >= least)


def buyer_trends(scores: DataFrame, tenders: DataFrame, *, last: int = 10) -> DataFrame:
    """(procuring_entity, trend, delta) over a buyer's ``last`` newest scored tenders.

    The mean of the newer half is compared with that of the older half; five points make a trend, and fewer than three
    scores make none.  ``delta`` is the last of these scores, newest first, less the first.
    """
    order = Window.partitionBy("procuring_entity").orderBy(F.col("publication_date").desc_nulls_last(), "tender_id")
    newest = scores.join(tenders.select("tender_id", "procuring_entity", "publication_date"), "tender_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= last)
    counted = newest.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("procuring_entity"))).withColumn("half", F.floor(F.col("all") / 2))
    halves = counted.groupBy("procuring_entity").agg(
        F.max("all").alias("all"), F.avg(F.when(F.col("n") <= F.col("half"), F.col("score"))).alias("newer"), F.avg(F.when(F.col("n") > F.col("half"), F.col("score"))).alias("older"),
        (F.max_by("score", "n") - F.min_by("score", "n")).alias("delta"),
    )
    move = F.col("newer") - F.col("older")
    trend = F.when(F.col("all") < 3, "stable").when(move > 5, "increasing").when(move < -5, "decreasing").otherwise("stable")
    return halves.select("procuring_entity", trend.alias("trend"), "delta")


def alerts(flags: DataFrame, tenders: DataFrame, watched: tuple[str, ...] = ()) -> DataFrame:
    """(tender_id, rule, severity) of six rules: a high index, a single bid of value, activity of a watched name, many flags,
    repeated wins at a buyer, and a buyer whose index rises.  Tenders without flags have the index zero."""
    cri = risk_index(flags).select("tender_id", "cri")
    per = flags.groupBy("tender_id").agg(row_count().alias("flags"), F.max(F.col("flag_type") == "single_bidder").alias("single"))
    repeat = F.when(F.col("winner").isNotNull(), F.count_if(F.col("status") == "awarded").over(Window.partitionBy("procuring_entity", "winner")))
    trends = buyer_trends(cri.withColumnRenamed("cri", "score"), tenders)
    rows = tenders.withColumn("repeat", repeat).join(cri, "tender_id", "left").join(per, "tender_id", "left").join(trends, "procuring_entity", "left").fillna(0, ["cri", "flags"])
    value = F.coalesce(F.nullif("actual_value_mkd", F.lit(0.0)), "estimated_value_mkd", F.lit(0.0))
    named = F.lower(F.concat_ws("\n", "winner", "procuring_entity"))
    seen = F.exists(F.array(*[F.lit(w.lower()) for w in watched]), lambda w: F.contains(named, w)) if watched else F.lit(False)

    def rule(name: str, holds: Column, *levels: tuple[Column, str], other: str = "medium") -> Column:
        severity = F.coalesce(*[F.when(c, s) for c, s in levels], F.lit(other))
        return F.when(holds, F.struct(F.lit(name).alias("rule"), severity.alias("severity")))

    score, n, again = F.col("cri"), F.col("flags"), F.col("repeat")
    rules = F.array_compact(F.array(
        rule("high_risk_score", score >= 70, (score >= 90, "critical"), (score >= 80, "high")),
        rule("single_bidder_high_value", F.col("single") & (value >= 5e6), (value >= 5e7, "critical"), (value >= 2e7, "high")),
        rule("watched_entity", seen, (score >= 70, "high"), (score >= 40, "medium"), other="low"),
        rule("multiple_flags", n >= 3, (n >= 6, "critical"), (n >= 5, "high")),
        rule("repeat_pattern", again >= 3, (again >= 10, "critical"), (again >= 6, "high")),
        rule("escalating_risk", F.col("trend") == "increasing", ((score >= 80) & (F.col("delta") >= 20), "critical"), ((score >= 60) | (F.col("delta") >= 15), "high")),
    ))
    return rows.select("tender_id", F.explode(rules).alias("r")).select("tender_id", "r.rule", "r.severity")


def match_alerts(tenders: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Tenders against subscriptions (alert_id, keyword, cpv4, buyer, low, high, and competitor if tracked): 25 points for the
    keyword in title or category, 30 for the code, 25 for the buyer, 20 for the value, 25 for the competitor as winner; 25 at
    least, 100 at most.

    A keyword in Latin letters is sought in Cyrillic too; one of up to three characters matches whole words only.  A null bound
    of the value is open, and a tender without a value has 0.  Fewer than 25 points are left without keyword, code, buyer
    and competitor, so tenders and subscriptions meet by one of these.
    """
    from bidscope.operators.cases import keyword_places

    s = subscriptions if "competitor" in subscriptions.columns else subscriptions.withColumn("competitor", F.lit(None).cast("string"))
    s = s.withColumn("forms", search_variants(F.col("keyword")))
    t = tenders.select("tender_id", F.concat_ws(" ", "title", "category").alias("text"), "cpv_code", "procuring_entity", "winner", "estimated_value_mkd")

    def met(value: str, part: Column) -> DataFrame:
        """(tender_id, alert_id) where a subscription's part of a name or text is in the tender's."""
        texts, parts = t.select("tender_id", F.col(value).alias("value")), s.select("alert_id", part.alias("keyword"))
        return texts.join(keyword_places(texts.select("value"), parts.select("keyword")), "value").join(parts, "keyword").select("tender_id", "alert_id")

    by_text, by_buyer = met("text", F.explode("forms")), met("procuring_entity", F.col("buyer"))
    by_code = t.select("tender_id", F.substring("cpv_code", 1, 4).alias("cpv4")).join(s.select("alert_id", "cpv4"), "cpv4").select("tender_id", "alert_id")
    pairs = by_text.unionByName(by_buyer).unionByName(by_code)
    if "competitor" in subscriptions.columns:
        pairs = pairs.unionByName(met("winner", F.col("competitor")))
    text = F.lower("text")
    words = F.split(text, r"[^\p{L}\p{N}_]+")
    hit = F.exists("forms", lambda form: F.when(F.length("keyword") > 3, F.contains(text, F.lower(form))).otherwise(F.array_contains(words, F.lower(form))))
    bounded = F.col("low").isNotNull() | F.col("high").isNotNull()
    value = F.coalesce("estimated_value_mkd", F.lit(0.0))
    points = (
        F.when(hit, 25).otherwise(0) + F.when(F.substring("cpv_code", 1, 4) == F.col("cpv4"), 30).otherwise(0)
        + F.when(F.contains(F.lower("procuring_entity"), F.lower("buyer")), 25).otherwise(0)
        + F.when(bounded & value.between(F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(float("inf")))), 20).otherwise(0)
        + F.when(F.contains(F.lower("winner"), F.lower("competitor")), 25).otherwise(0)
    )
    scored = pairs.distinct().join(t, "tender_id").join(s, "alert_id").select("tender_id", "alert_id", F.least(points, F.lit(100)).alias("match_score"))
    return scored.filter("match_score >= 25")


def tender_features(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """A row of numbers per tender: competition, price, timing, relationship strictly before publication, procedure."""
    v = F.col("bid_amount_mkd")
    bids = bidders.groupBy("tender_id").agg(
        row_count().alias("bids"), F.count_if("disqualified").alias("disqualified"), F.avg(v).alias("mean_bid"), F.stddev_pop(v).alias("sd_bid"), F.min(v).alias("low_bid"), F.max(v).alias("high_bid"), F.percentile(v, 0.5).alias("median_bid")
    )
    day = F.datediff("publication_date", F.lit(date(1970, 1, 1)))
    before = lambda *keys: Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    is_award = F.when(F.col("status").isin(*AWARDED), 1)
    t = tenders.withColumns({"buyer_before": row_count().over(before("procuring_entity")), "buyer_awards_before": F.count(is_award).over(before("procuring_entity")), "pair_wins_before": F.when(F.col("winner").isNotNull(), F.count(is_award).over(before("procuring_entity", "winner")))})
    j = t.join(bids, "tender_id", "left")
    r = lambda x: F.round(x, 9)
    return j.select(
        "tender_id", F.coalesce("bids", F.lit(0)).alias("bids"), (F.col("disqualified") / F.col("bids")).alias("disqualified_rate"), F.round("mean_bid", 4).alias("mean_bid"), r(F.try_divide("sd_bid", "mean_bid")).alias("bid_cov"),
        F.try_divide(F.col("high_bid") - F.col("low_bid"), F.col("low_bid")).alias("bid_range"), r(F.col("median_bid") / F.nullif("estimated_value_mkd", F.lit(0.0))).alias("median_to_estimate"),
        (F.col("actual_value_mkd") / F.nullif("estimated_value_mkd", F.lit(0.0))).alias("actual_to_estimate"), F.datediff("closing_date", "publication_date").alias("days_open"), F.weekday("publication_date").alias("weekday"), F.month("publication_date").alias("month"),
        "buyer_before", "buyer_awards_before", "pair_wins_before", (F.col("procedure_type").contains("Negotiated")).cast("int").alias("negotiated"), "amendment_count",
    )


def buyer_timeline(tenders: DataFrame) -> DataFrame:
    """Per buyer and month: tenders, share of single bids, and the change against the mean of the months before."""
    m = tenders.groupBy("procuring_entity", F.date_trunc("month", "publication_date").cast("date").alias("month")).agg(row_count().alias("tenders"), F.round(F.count_if(F.col("num_bidders") == 1) * 100.0 / row_count(), 6).alias("single_share"), F.sum("estimated_value_mkd").alias("estimated"))
    w = Window.partitionBy("procuring_entity").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.avg("tenders").over(w)
    return m.withColumns({"mean_before": F.round(mean, 6), "spike": F.coalesce(F.col("tenders") > 2 * mean, F.lit(False))})


def psi(reference: DataFrame, current: DataFrame, column: str, *, bins: int = 10) -> DataFrame:
    """Population stability index of a column between two sets, over quantile bins of the first: (bin, expected, actual, psi).

    Quantiles are values of the column, off by a millionth of the rows at most; what is gathered for them is bounded.
    """
    row = reference.filter(F.col(column).isNotNull()).agg(F.percentile_approx(column, [i / bins for i in range(1, bins)], 1_000_000)).first()[0] or []
    cuts = sorted(set(row))
    number = sum((F.when(F.col(column) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    count = lambda df, name: df.filter(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(row_count().alias(name))
    j = count(reference, "a").join(count(current, "b"), "bin", "full").fillna(0, ["a", "b"])
    w = Window.partitionBy(F.lit(1))  # at most ``bins`` rows
    e, o = F.greatest(F.col("a") / F.sum("a").over(w), F.lit(1e-6)), F.greatest(F.col("b") / F.sum("b").over(w), F.lit(1e-6))
    return j.select("bin", F.round(e, 6).alias("expected"), F.round(o, 6).alias("actual"), F.round((o - e) * F.log(o / e), 6).alias("psi"))


def change_points(series: DataFrame, key: str, order: str, value: str, *, threshold: float = 4.5, drift: float = 0.5, apart: int = 5, least: int = 10) -> DataFrame:
    """(key, position, direction): two-sided CUSUM per key, its sums reset after each change, changes some rows apart.

    The reset makes each row depend on the rows before it, so a key's series is walked in order; series are short, one row
    per key and period.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf["__v"].to_numpy(float)
        found = []
        sd = x.std()
        if len(x) >= least and sd > 0:
            z = (x - x.mean()) / sd
            up = down = 0.0
            last = -apart
            for n, v in enumerate(z):
                up, down = max(0.0, up + v - drift), max(0.0, down - v - drift)
                if max(up, down) > threshold:
                    if n - last >= apart:
                        found.append((pdf["__k"].iloc[0], n, "up" if up > down else "down"))
                        last = n
                    up = down = 0.0
        return pd.DataFrame(found, columns=["key", "position", "direction"])

    rows = series.select(F.col(key).cast("string").alias("__k"), F.col(order), F.col(value).cast("double").alias("__v")).filter("__v is not null")
    return rows.groupBy("__k").applyInPandas(walk, "key string, position int, direction string")


def train_risk_model(features: DataFrame, label: str = "label", *, trees: int = 20, seed: int = 7):
    """Median imputation, assembly and a random forest, as one fitted MLlib pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    columns = [c for c, t in features.dtypes if c not in ("tender_id", label) and t in ("int", "bigint", "double")]
    cast = features.select("tender_id", label, *[F.col(c).cast("double").alias(c) for c in columns])
    filled = [f"{c}_f" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"), RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=6, seed=seed)]
    return Pipeline(stages=stages).fit(cast), cast
