"""What follows a flag: alerts enriched, filtered and counted, briefings, verification, tips; and features of models."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.rounding import scaled_round
from bidscope.operators.detectors import AWARDED, banded
from bidscope.operators.risk import buyer_trends, severity_rank
from bidscope.workspace import materialize

#: Points of a tip's category.
TIP_CATEGORIES = {"bid_rigging": 8.0, "bribery": 7.0, "conflict_of_interest": 6.0, "fraud": 7.0}


def row_count() -> Column:
    return F.count(F.lit(1))


def high_risk(flags: DataFrame, tenders: DataFrame) -> DataFrame:
    """Tenders with a flag of high severity or worse: all their flag types, best score and the parties."""
    per = flags.groupBy("tender_id").agg(F.array_join(F.sort_array(F.collect_set("flag_type")), ",").alias("types"), F.max("score").alias("score"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    return per.filter("worst >= 3").join(tenders.select("tender_id", "procuring_entity", "winner", "estimated_value_mkd"), "tender_id")


def enriched_alerts(scores: DataFrame, tenders: DataFrame) -> DataFrame:
    """(tender_id, repeat_wins, trend): wins of the winner at the buyer, and how the buyer's scores move."""
    pair = Window.partitionBy("procuring_entity", "winner")
    t = tenders.withColumn("repeat_wins", F.when(F.col("winner").isNull(), 0).otherwise(F.count_if(F.col("status") == "awarded").over(pair)))
    return t.join(scores.select("tender_id"), "tender_id").join(buyer_trends(scores, tenders), "procuring_entity").select("tender_id", "repeat_wins", "trend")


def due_alerts(alerts: DataFrame, users: DataFrame, sent: DataFrame) -> DataFrame:
    """(user_id, tender_id, rule, severity): alerts of a user's severity or worse that were not sent before.

    ``users`` has (user_id, least, rule), one row for each rule a user follows; ``sent`` (user_id, tender_id, rule).
    """
    j = alerts.join(users, "rule").filter(severity_rank(F.col("severity")) >= severity_rank(F.col("least")))
    return j.select("user_id", "tender_id", "rule", "severity").dropDuplicates(["user_id", "tender_id", "rule"]).join(sent, ["user_id", "tender_id", "rule"], "left_anti")


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Counts by severity and by rule, with the grain named."""
    sets = alerts.groupingSets([["severity"], ["rule"]], "severity", "rule").agg(row_count().alias("alerts"), F.count_distinct("tender_id").alias("tenders"))
    return sets.select(F.when(F.col("severity").isNotNull(), "severity").otherwise("rule").alias("grain"), F.coalesce("severity", "rule").alias("name"), "alerts", "tenders")


def briefings(matches: DataFrame) -> DataFrame:
    """Per subscription its matches in groups of priority, and its three best as text."""
    priority = banded("match_score", (75, "high"), (50, "medium"), other="low")
    per = matches.withColumn("priority", priority).groupBy("alert_id").agg(row_count().alias("matches"), *[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")])
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc("match_score"), "tender_id"))
    first = matches.withColumn("place", place).filter("place <= 3").groupBy("alert_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "tender_id"))), lambda x: x["tender_id"]), ",").alias("first"))
    return per.join(first, "alert_id")


def unread_matches(matches: DataFrame, reads: DataFrame, tenders: DataFrame) -> DataFrame:
    """Matches that were not read, of tenders still open, with what a list shows."""
    left = matches.join(reads, ["alert_id", "tender_id"], "left_anti")
    return left.join(tenders.filter("status = 'open'").select("tender_id", "title", "closing_date"), "tender_id")


def tip_scores(tips: DataFrame) -> DataFrame:
    """(doc_id, triage, urgency) of texts (doc_id, text, category, matched_tenders, matched_entities).

    Detail: length, names, amounts, dates and links; specificity: what was matched to known records.
    """
    low = F.coalesce("text", F.lit(""))
    n = lambda pattern: F.regexp_count(low, F.lit(pattern))
    capped = lambda c, each: F.least(c * each, F.lit(1.0))
    t = tips.select("doc_id", "category", "matched_tenders", "matched_entities", F.length(low).alias("len"), n(r"[A-Z][a-z]+ [A-Z][a-z]+").alias("names"), n(r"[0-9]{1,3}(?:[.,][0-9]{3})+").alias("amounts"), n(r"[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("dates"), n(r"https?://").alias("links"))
    length = F.when(F.col("len") > 0, F.least(F.log(F.col("len") + 1) / F.log(F.lit(1001.0)), F.lit(1.0))).otherwise(0.0)
    detail = 0.25 * length + 0.20 * capped(F.col("names"), 0.2) + 0.20 * capped(F.col("matched_tenders"), 0.5) + 0.10 * capped(F.col("amounts"), 0.5) + 0.10 * capped(F.col("dates"), 0.33) + 0.15 * capped(F.col("links"), 0.5)
    specific = 0.40 * capped(F.col("matched_tenders"), 0.3) + 0.30 * capped(F.col("matched_entities"), 0.25) + 0.15 * capped(F.col("amounts"), 0.5) + 0.15 * capped(F.col("dates"), 0.33)
    kind = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in TIP_CATEGORIES.items()], F.lit(0.0))
    total = (0.35 * F.least(detail, F.lit(1.0)) + 0.40 * F.least(specific, F.lit(1.0))) * 100 + F.least("links", F.lit(3)) * 5.0 + kind + F.least(F.col("matched_tenders") * 3.0 + F.col("matched_entities") * 2.0, F.lit(15.0))
    scored = t.withColumn("triage", F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(100.0))), 6))
    step = F.when(F.col("triage") >= 75, 3).when(F.col("triage") >= 55, 2).when(F.col("triage") >= 30, 1).otherwise(0) + F.when((F.col("category") == "bribery") | (F.col("amounts") > 0), 1).otherwise(0)
    return scored.select("doc_id", "triage", F.element_at(F.array(*[F.lit(u) for u in ("low", "medium", "high", "critical")]), F.least(step, F.lit(3)) + 1).alias("urgency"))


def verification_summary(verdicts: DataFrame) -> DataFrame:
    """Per flag type: verdicts, how many confirm it, the share, and the tenders on which reviewers disagree."""
    per = verdicts.groupBy("flag_type", "tender_id").agg(row_count().alias("n"), F.count_if("confirmed").alias("yes"))
    return per.groupBy("flag_type").agg(F.sum("n").alias("verdicts"), F.sum("yes").alias("confirmed"), F.round(F.sum("yes") * 100.0 / F.sum("n"), 4).alias("share"), F.count_if((F.col("yes") > 0) & (F.col("yes") < F.col("n"))).alias("disputed"))


# --- features -----------------------------------------------------------------------------------------------------------


def price_features(tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per tender: spread, gaps, quartiles and round numbers of its bids, and the winning bid against estimate and others."""
    v = F.col("bid_amount_mkd")
    order = Window.partitionBy("tender_id").orderBy("bid_amount_mkd", "company_name")
    gap = v - F.lag(v).over(order)
    b = bidders.withColumns({"gap": gap, "place": F.row_number().over(order)}).groupBy("tender_id").agg(
        row_count().alias("bids"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"),
        F.max(F.when(F.col("place") == 2, F.col("gap"))).alias("first_gap"), F.min("gap").alias("least_gap"), F.count_if(v % 1000 == 0).alias("round_bids"), F.max(F.when(F.col("is_winner"), v)).alias("winning"),
    )
    r = lambda c: F.round(c, 6)
    est = F.nullif("estimated_value_mkd", F.lit(0.0))
    return tenders.select("tender_id", "estimated_value_mkd").join(b, "tender_id").select(
        "tender_id", "bids", r(F.col("sd") / F.nullif("mean", F.lit(0.0))).alias("cov"), F.round((F.col("q3") - F.col("q1")) / F.nullif("mean", F.lit(0.0)), 4).alias("iqr"), "first_gap", "least_gap", "round_bids",
        r(F.col("winning") / est).alias("winning_to_estimate"), r(F.col("low") / est).alias("low_to_estimate"), r((F.col("mean") - F.col("winning")) / F.nullif("sd", F.lit(0.0))).alias("winner_z"), (F.col("winning") == F.col("low")).alias("lowest_won"),
    )


def timing_features(tenders: DataFrame) -> DataFrame:
    d = lambda a, b: F.datediff(a, b)
    open_days = d("closing_date", "publication_date")
    return tenders.select(
        "tender_id", open_days.alias("open_days"), d("contract_signing_date", "closing_date").alias("decision_days"), (open_days < 7).alias("short"), (F.weekday("publication_date") >= 5).alias("weekend"), F.quarter("publication_date").alias("quarter"),
        (F.month("publication_date") == 12).alias("year_end"), d("closing_date", "last_amendment_date").alias("since_amendment"), (F.dayofmonth("publication_date") >= 25).alias("month_end"),
    )


def procedural_features(tenders: DataFrame) -> DataFrame:
    p = F.lower("procedure_type")
    return tenders.select(
        "tender_id", p.contains("negotiated").cast("int").alias("negotiated"), p.contains("lowestimated").cast("int").alias("low_value"), (p == "open").cast("int").alias("open"), F.contains("evaluation_method", F.lit("lowest")).cast("int").alias("lowest_price"),
        "amendment_count", (F.col("amendment_count") > 2).cast("int").alias("many_amendments"), F.col("winner").isNotNull().cast("int").alias("has_winner"), (F.col("estimated_value_mkd") > 5e6).cast("int").alias("large"),
    )


def document_features(documents: DataFrame) -> DataFrame:
    """Per tender (tender_id, text): documents, their lengths, empty and repeated ones."""
    n = F.length(F.coalesce("text", F.lit("")))
    return documents.groupBy("tender_id").agg(row_count().alias("documents"), F.sum(n).alias("characters"), F.round(F.avg(n), 4).alias("mean_length"), F.max(n).alias("longest"), F.count_if(n < 100).alias("tiny"), (row_count() - F.count_distinct(F.coalesce("text", F.lit("")))).alias("repeated"))


def history_features(tenders: DataFrame, as_of: date) -> DataFrame:
    """Per tender: its age, its buyer's tenders of the month and of the month before, and whether the month is a spike."""
    month = F.date_trunc("month", "publication_date").cast("date")
    per = tenders.groupBy("procuring_entity", month.alias("month")).agg(row_count().alias("in_month"))
    w = Window.partitionBy("procuring_entity").orderBy("month")
    before = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("in_month").over(w)).otherwise(0)
    mean = F.avg("in_month").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = per.withColumns({"month_before": before, "spike": F.coalesce(F.col("in_month") > 2 * mean, F.lit(False))})
    t = tenders.select("tender_id", "procuring_entity", month.alias("month"), F.datediff(F.lit(as_of), "publication_date").alias("age"))
    return t.join(m, ["procuring_entity", "month"]).select("tender_id", "age", "in_month", "month_before", "spike")


def batch_features(tenders: DataFrame) -> DataFrame:
    """The short set that batch scoring reads: value, competition, timing, and rates of the buyer and the winner before the tender.

    History is summed per buyer, winner and day before anything is windowed, so no window holds more than the days of a buyer, or
    of a winner at each buyer; tenders meet it on those three, so those without a winner are no one group either.
    """
    day = F.datediff("publication_date", F.lit(date(1970, 1, 1)))
    r = lambda c: scaled_round(c, 6)
    tenders = materialize(tenders.select("tender_id", "estimated_value_mkd", "num_bidders", "closing_date", "publication_date", "amendment_count", "procuring_entity", "winner", "status"), "feature-rows")
    rows = tenders.select(
        "tender_id", r(F.log(1 + F.col("estimated_value_mkd"))).alias("log_value"), F.coalesce("num_bidders", F.lit(0)).alias("bidders"), F.datediff("closing_date", "publication_date").alias("open_days"), "amendment_count",
        F.col("procuring_entity").alias("buyer"), "winner", day.alias("day"),
    )
    single, award = F.when(F.col("num_bidders") == 1, 1.0).otherwise(0.0), F.when(F.col("status").isin(*AWARDED), 1).otherwise(0)
    days = tenders.groupBy(F.col("procuring_entity").alias("buyer"), "winner", day.alias("day")).agg(row_count().alias("n"), F.sum(single).alias("single"), F.sum(award).alias("awards"))
    before = lambda c, *keys: F.sum(c).over(Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1))
    earlier = lambda *keys: F.when(F.col("winner").isNotNull(), F.coalesce(before("awards", *keys), F.lit(0)))
    buyers = days.groupBy("buyer", "day").agg(F.sum("n").alias("n"), F.sum("single").alias("single"))
    buyers = buyers.select("buyer", "day", F.coalesce(before("n", "buyer"), F.lit(0)).alias("buyer_tenders"), r(before("single", "buyer") / before("n", "buyer")).alias("buyer_single_rate"))
    past = days.select("buyer", "winner", "day", earlier("winner").alias("winner_awards"), earlier("buyer", "winner").alias("pair_awards"))
    return on_equal(on_equal(rows, past, "buyer", "winner", "day"), buyers, "buyer", "day").select(
        "tender_id", "log_value", "bidders", "open_days", "amendment_count", "buyer_tenders", "buyer_single_rate", "winner_awards", "pair_awards"
    )


def on_equal(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with what ``table`` holds for their keys, a null being equal to a null."""
    named = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"__{k}"]) for k in keys])
    return rows.join(named, same).drop(*[f"__{k}" for k in keys])


def latest_predictions(predictions: DataFrame, since: date, least: float) -> DataFrame:
    """The newest prediction (tender_id, made_on, model, score) of each tender, where it is recent and high."""
    last = predictions.groupBy("tender_id").agg(F.max(F.struct("made_on", "model", "score")).alias("m")).select("tender_id", "m.*")
    return last.filter((F.col("made_on") >= F.lit(since)) & (F.col("score") >= least)).withColumn("level", banded("score", (80, "critical"), (60, "high"), (40, "medium"), (20, "low"), other="minimal"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not processed yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


# --- edges --------------------------------------------------------------------------------------------------------------


def direct_connections(edges: DataFrame) -> DataFrame:
    """(node, other, direction, weight): each node's neighbours with out, in or both."""
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", F.lit(1).alias("way")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight", F.lit(2).alias("way")))
    return ways.groupBy("node", "other").agg(F.bit_or("way").alias("ways"), F.sum("weight").alias("weight")).select("node", "other", F.element_at(F.array(F.lit("out"), F.lit("in"), F.lit("both")), F.col("ways")).alias("direction"), "weight")


def weak_labels(relations: DataFrame) -> DataFrame:
    """(company, label): companies on either side of a confident relation (a, b, confidence), each once."""
    sure = relations.filter("confidence >= 70")
    return sure.select(F.col("a").alias("company")).union(sure.select("b")).distinct().withColumn("label", F.lit(1))


def merged_clusters(members: DataFrame, *, least: float = 0.6) -> DataFrame:
    """(cluster, member): clusters (cluster, member) that share ``least`` of their members together become one, named by the least.

    Overlaps are counted over shared members; chains of overlapping clusters join whatever their order.
    """
    from bidscope.operators.graph import connected_components

    m = members.select("cluster", "member").distinct()
    size = m.groupBy("cluster").agg(row_count().alias("n"))
    other = m.select(F.col("cluster").alias("other"), "member")
    shared = m.join(other, "member").filter("cluster < other").groupBy("cluster", "other").agg(row_count().alias("both"))
    j = shared.join(size, "cluster").join(size.select(F.col("cluster").alias("other"), F.col("n").alias("m")), "other")
    links = j.filter(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= least).select(F.col("cluster").alias("src"), F.col("other").alias("dst"), F.lit(1).alias("weight"))
    root = connected_components(links)
    return m.join(root, F.col("cluster") == F.col("node"), "left").select(F.coalesce("component", "cluster").alias("cluster"), "member").distinct()


def cluster_tenders(members: DataFrame, bidders: DataFrame, tenders: DataFrame) -> DataFrame:
    """Per cluster: tenders in which at least two of its members bid, their value and buyers, wins of members."""
    j = bidders.join(members.select("cluster", F.col("member").alias("company_name")), "company_name")
    per = j.groupBy("cluster", "tender_id").agg(row_count().alias("n"), F.max("is_winner").alias("won")).filter("n >= 2")
    t = per.join(tenders.select("tender_id", "estimated_value_mkd", "procuring_entity"), "tender_id")
    return t.groupBy("cluster").agg(row_count().alias("tenders"), F.sum("estimated_value_mkd").alias("value"), F.count_distinct("procuring_entity").alias("buyers"), F.count_if("won").alias("won"))
