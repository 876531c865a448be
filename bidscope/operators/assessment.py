"""Uncertainty of the risk index, review queues, weight calibration, evaluation of scores, and temporal profiles."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.operators.detectors import WEIGHTS, risk_index, weight_of


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashed_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """``F.xxhash64`` of longs, for arrays."""
    h = np.uint64(seed) + _P5 + np.uint64(8)
    return _mixed(_turned(h ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4)


def _hashed_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of positive ints that follow what gave ``seed``."""
    h = seed + _P5 + np.uint64(4)
    return _mixed(_turned(h ^ (x * _P1), 23) * _P2 + _P3)


def bootstrap_interval(flags: DataFrame, *, draws: int = 1000, noise: float = 0.10, level: float = 0.90, bonus: int = 8) -> DataFrame:
    """(tender_id, cri, ci_lower, ci_upper): the index under uniform noise on each type's score.

    The noise of a draw is a hash of (tender, type, draw), so reruns agree.  A tender has a flag of each type at most, so
    its draws are made within its row and only its flags are shuffled; draws of many rows are made at once, as arrays.
    """
    per = flags.groupBy("tender_id", "flag_type").agg(F.max("score").alias("score")).withColumn("w", weight_of(F.col("flag_type")))
    rows = per.groupBy("tender_id").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("s"), F.col("w").cast("double").alias("w"), F.xxhash64("tender_id", "flag_type").alias("h"))).alias("f"), F.sum("w").cast("double").alias("all"))

    def bound(x: np.ndarray, share: float) -> np.ndarray:
        at = share * (draws - 1)
        low = int(at)
        return x[:, low] + (at - low) * (x[:, min(low + 1, draws - 1)] - x[:, low])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, draws + 1, dtype=np.uint64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):  # so many rows' draws at once
                part = batch.slice(begin, 512)
                lists = part.column(1)
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                score, weight, key = (np.asarray(v) for v in lists.flatten().flatten())
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                total = np.zeros((len(size), draws))
                for k in range(int(size.max(initial=0))):  # a row's k-th flag
                    rows = np.flatnonzero(size > k)
                    at = first[rows] + k
                    u = (_hashed_int(number[None, :], _hashed_long(key[at].astype(np.int64).view(np.uint64))[:, None]) >> np.uint64(11)) / float(1 << 53)
                    total[rows] += np.clip(score[at][:, None] * (1 + (u * 2 - 1) * noise), 0.0, 100.0) * weight[at][:, None]
                x = np.minimum(100.0, np.rint(total / part.column(2).to_numpy(zero_copy_only=False)[:, None] + (bonus * (size - 1))[:, None]))
                x.sort(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(bound(x, s)) for s in ((1 - level) / 2, 1 - (1 - level) / 2)]], names=["tender_id", "ci_lower", "ci_upper"])

    found = rows.select("tender_id", F.array_sort("f").alias("f"), "all").mapInArrow(drawn, "tender_id string, ci_lower double, ci_upper double")
    bounds = found.select("tender_id", F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"))
    return risk_index(flags, rounding="round").select("tender_id", "cri").join(bounds, "tender_id")


def uncertainty(width: Column, completeness: Column) -> Column:
    full = completeness >= 0.70
    return F.when(width <= 10, F.when(full, "low").otherwise("medium")).when(width <= 25, F.when(full, "medium").otherwise("high")).otherwise("high")


def completeness(features: DataFrame, key: str = "tender_id") -> DataFrame:
    """The share of a row's features that are known and not zero or empty."""
    names = [c for c in features.columns if c != key]
    present = sum(((F.col(c).isNotNull()) & (~F.col(c).cast("string").isin("0", "0.0", "", "NaN"))).cast("int") for c in names)
    return features.select(key, F.round(present / len(names), 6).alias("completeness"))


def review_queue(flags: DataFrame, predictions: DataFrame, *, size: int = 50, middle: int = 50, band: int = 15, gap: int = 20, rare: int = 3) -> DataFrame:
    """(tender_id, reason, priority): half of the queue at the index's boundary, three tenths where the index and a model's
    score (tender_id, score) are over ``gap`` apart, two tenths with combinations of flag types that are rare.

    A tender found twice stands under the first of these.
    """
    cri = risk_index(flags).select("tender_id", "cri").join(flags.groupBy("tender_id").agg(F.count(F.lit(1)).alias("flags")), "tender_id")
    combos = flags.groupBy("tender_id").agg(F.array_join(F.sort_array(F.collect_set("flag_type")), ",").alias("combo"))
    freq = combos.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= rare)
    off, apart = F.abs(F.col("cri") - middle), F.abs(F.col("cri") - F.col("score"))
    row = lambda n, reason, priority: ("tender_id", F.lit(n).alias("rule"), F.lit(reason).alias("reason"), F.round(priority, 6).alias("priority"))
    edge = cri.filter(off <= band).orderBy(off, F.desc("flags"), "tender_id").limit(size * 5 // 10).select(*row(1, "boundary", 1 / (1 + off)))
    split = cri.join(predictions, "tender_id").filter(apart > gap).orderBy(F.desc(apart), "tender_id").limit(size * 3 // 10).select(*row(2, "disagreement", apart / 100))
    odd = combos.join(freq, "combo").orderBy("n", "tender_id").limit(size * 2 // 10).select(*row(3, "novel", 1 / F.col("n")))
    each = edge.unionByName(split).unionByName(odd)
    return each.groupBy("tender_id").agg(F.min(F.struct("rule", "reason", "priority")).alias("r")).select("tender_id", "r.reason", "r.priority")


def calibrated_weights(flags: DataFrame, verdicts: DataFrame, *, least_reviews: int = 50, most_change: float = 0.2) -> dict[str, float] | None:
    """New weights per flag type from reviewed tenders (tender_id, fraud 0/1): logistic regression on standardized scores,
    exp of its coefficients over their mean, moved by at most ``most_change`` and kept within 0.1 and 3; None with too few reviews."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    kinds = list(WEIGHTS)
    x = flags.join(verdicts, "tender_id").groupBy("tender_id", "fraud").pivot("flag_type", kinds).agg(F.max("score")).fillna(0)
    counts = {r["fraud"]: r["count"] for r in x.groupBy("fraud").count().collect()}
    if sum(counts.values()) < least_reviews or len(counts) < 2:
        return None
    x = x.select(F.col("fraud").cast("double").alias("fraud"), *[F.col(k).cast("double").alias(k) for k in kinds])
    model = Pipeline(stages=[VectorAssembler(inputCols=kinds, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="fraud", regParam=1.0)]).fit(x)
    import math

    raised = [math.exp(c) for c in model.stages[-1].coefficients.toArray()]
    mean = sum(raised) / len(raised)
    return {k: round(min(3.0, max(0.1, WEIGHTS[k] + max(-most_change * WEIGHTS[k], min(most_change * WEIGHTS[k], e / mean - WEIGHTS[k])))), 3) for k, e in zip(kinds, raised, strict=True)}


def threshold_sweep(scored: DataFrame, *, steps: int = 20) -> DataFrame:
    """(threshold, precision, recall, f1) of rows (score 0 to 1, label 0/1) at evenly spread thresholds.

    Rows are counted per step first; the sums over higher steps run over at most ``steps`` + 1 rows.
    """
    bins = scored.withColumn("bin", F.least(F.lit(steps), F.floor(F.col("score") * steps)).cast("int")).groupBy("bin").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("bin"))
    cum = bins.select("bin", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("flagged"), F.sum("pos").over(Window.partitionBy(F.lit(1))).alias("all_pos"))
    precision, recall = F.col("tp") / F.col("flagged"), F.try_divide("tp", "all_pos")
    return cum.select((F.col("bin") / steps).alias("threshold"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"))


def calibration(scored: DataFrame, *, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share, gap) of rows (score, label); the expected calibration error is the gaps' mean by n."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    per = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.avg("label").alias("p"))
    return per.select("bin", "n", F.round("m", 6).alias("mean_score"), F.round("p", 6).alias("share"), F.round(F.abs(F.col("m") - F.col("p")), 6).alias("gap"))


def conformal_quantile(scored: DataFrame, *, alpha: float = 0.1) -> float:
    """The radius q such that score +- q covers new labels with chance 1 - alpha."""
    import math

    gap = F.abs(F.col("score") - F.col("label"))
    n = scored.count()
    level = min(1.0, math.ceil((1 - alpha) * (n + 1)) / n) if n else 1.0
    return float(scored.agg(F.percentile(gap, level)).first()[0] or 0.0)


def balanced_labels(flagged: DataFrame, tenders: DataFrame, *, ratio: float = 2.0, seed: int = 7) -> DataFrame:
    """Flagged tenders as positives and, for each, about ``ratio`` clean ones drawn by a hash of their ids, with class weights."""
    positives = flagged.select("tender_id").distinct().withColumn("label", F.lit(1))
    clean = tenders.select("tender_id").join(positives, "tender_id", "left_anti")
    p, c = positives.count(), clean.count()
    share = min(1.0, ratio * p / c) if c else 0.0
    u = F.shiftrightunsigned(F.xxhash64("tender_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    both = positives.unionByName(clean.filter(u < share).withColumn("label", F.lit(0)))
    w = Window.partitionBy(F.lit(1))  # two rows
    sizes = both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.round(F.sum("n").over(w) / (2 * F.col("n")), 6))
    return both.join(F.broadcast(sizes.select("label", "weight")), "label")


def temporal_profile(tenders: DataFrame, flags: DataFrame, as_of: date, *, last: int = 20, least: int = 5) -> DataFrame:
    """Per buyer: mean index in the last 30, 90 and 365 days, slope and spread over its last tenders, pace, and the direction these show."""
    cri = risk_index(flags).select("tender_id", "cri")
    rows = tenders.select("tender_id", "procuring_entity", "publication_date", "num_bidders").join(cri, "tender_id", "left").fillna(0, ["cri"])
    back = Window.partitionBy("procuring_entity").orderBy(F.desc("publication_date"), F.desc("tender_id"))
    rows = rows.withColumns({"back": F.row_number().over(back), "age": F.datediff(F.lit(as_of), "publication_date")})
    recent = F.when(F.col("back") <= last, F.col("cri").cast("double"))
    x = F.when(F.col("back") <= last, -F.col("back").cast("double"))
    in_days = lambda d: F.round(F.avg(F.when(F.col("age").between(0, d), F.col("cri"))), 6)
    span = F.greatest(F.datediff(F.max("publication_date"), F.min("publication_date")), F.lit(1))
    per = rows.groupBy("procuring_entity").agg(
        F.count(F.lit(1)).alias("tenders"), in_days(30).alias("mean_30d"), in_days(90).alias("mean_90d"), in_days(365).alias("mean_365d"), F.round(F.regr_slope(recent, x), 6).alias("slope"), F.round(F.stddev_pop(recent), 6).alias("volatility"),
        F.min(F.when(F.col("cri") > 0, F.col("age"))).alias("days_since_flag"), F.round(F.count(F.lit(1)) / (span / 30.0), 6).alias("pace"),
    ).filter(F.col("tenders") >= least)
    return per.withColumn("trajectory", F.when(F.col("slope") > 1, "escalating").when(F.col("slope") < -1, "improving").when(F.col("volatility") > 20, "volatile").otherwise("stable"))
