"""Specifications, like names, conflicts, reviews and histories on small tables, against plain Python."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from bidscope.functions import specifications, text
from bidscope.operators import assessment, graph, history, matching, risk

TENDERS = "tender_id string, procuring_entity string, winner string, status string, publication_date date, num_bidders int"


def test_like_names_equal_all_pairs(spark):
    draw = random.Random(3)
    names = sorted({" ".join(draw.choice(["red", "reed", "bolt", "bold", "gear", "gears", "small", "smaller", "x"]) for _ in range(draw.randint(1, 3))) for _ in range(60)} | {""})

    def pieces(name):
        return {f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)}

    want = set()
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            x, y = pieces(a), pieces(b)
            if x | y and len(x & y) / len(x | y) > 0.3:
                want.add((a, b, round(len(x & y) / len(x | y), 6)))
    df = spark.createDataFrame([(n,) for n in [*names, *names[:5], None]], "name string")
    assert {(r.a, r.b, r.similarity) for r in text.similar_names(df).collect()} == want


def test_brands_and_qualifications(spark):
    rows = [(1, 'DELL and dell, Acme Turbo™ or USB or equivalent; P/N: ZX-99 and "Silent Master" или еквивалент'), (2, None), (3, ""), (4, "ISO 9001, ISO 14001, ISO 27001 и промет од 60.000.000 мкд, најмалку 51 вработени")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", specifications.brands(F.col("text")).alias("b"), specifications.qualifications(F.col("text")).alias("q")).collect()}
    kinds = {b["brand"]: b["kind"] for b in got[1].b}
    assert kinds["DELL"] == "known_brand" and kinds["Acme Turbo"] == "trademark" and kinds["USB"] == "or_equivalent" and kinds["Silent Master"] == "or_equivalent" and kinds["ZX-99"] == "part_number"
    assert len({b["brand"].lower() for b in got[1].b}) == len(got[1].b) and not got[2].b and not got[3].q
    assert {(q["kind"], q["excessive"]) for q in got[4].q} == {("certification", True), ("turnover", True), ("financial_threshold", False), ("employees", True)}
    chance = {r.doc_id: r.probability for r in specifications.assessed(df).collect()}
    assert chance[2] == chance[3] == pytest.approx(0.075) and all(0 <= p <= 1 for p in chance.values())


def test_conflicts_equal_pairs_of_tenders(spark):
    draw = random.Random(5)
    tenders = [(f"T{n}", draw.choice(["A", "B", None]), draw.choice(["X", "Y", "A", None])) for n in range(40)]
    mentions = [(draw.choice(["ann", "bob", "", None]), draw.choice(tenders)[0], draw.randint(1, 9) / 10) for _ in range(90)]
    best = {}
    for name, tid, c in mentions:
        if name:
            best[name, tid] = max(c, best.get((name, tid), 0))
    by = {t[0]: t for t in tenders}
    pairs = {}
    for (n1, t1), c in best.items():
        for n2, t2 in best:
            buyer, company = by[t1][1], by[t2][2]
            if n1 == n2 and t1 != t2 and buyer and company and buyer != company:
                pairs.setdefault((n1, buyer, company), []).append((t1, t2, c))
    want = {k: (len({p[0] for p in v}) + len({p[1] for p in v}), round(sum(p[2] for p in v) / len(v), 3)) for k, v in pairs.items() if len({p[0] for p in v}) >= 2 or len({p[1] for p in v}) >= 2}
    got = matching.person_conflicts(spark.createDataFrame(mentions, "name string, tender_id string, confidence double"), spark.createDataFrame(tenders, "tender_id string, procuring_entity string, winner string"))
    assert {(r.name, r.institution, r.company): (r.mentions, pytest.approx(r.confidence, abs=1e-3)) for r in got.collect()} == want


def test_terms_are_bounded_and_doors(spark):
    items = spark.createDataFrame([("T1", "big red bolt", 2.0), ("T1", None, 3.0), ("T2", "Red Bolt", 4.0), ("T3", "red bolt", 0.0)], "tender_id string, name string, unit_price double")
    rows = matching.term_aggregates(items, ["RED bolt"]).collect()
    assert [(r.term, r.low, r.high, r.mean, r.tenders) for r in rows] == [("red bolt", 2.0, 4.0, 3.0, 2)]
    with pytest.raises(ValueError):
        matching.term_aggregates(items, [str(n) for n in range(101)])
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 4.0)], "src string, dst string, value double")
    assert {tuple(r) for r in graph.revolving_doors(edges).collect()} == {("a", 1, 1.0, 1, 4.0), ("b", 2, 6.0, 1, 1.0)}


def test_review_queue_shares_and_alert_levels(spark):
    flags = spark.createDataFrame([(f"T{n}", "single_bidder", 40 + n % 20, "high") for n in range(60)] + [("T0", "late_amendment", 55, "low")], "tender_id string, flag_type string, score int, severity string")
    scores = spark.createDataFrame([(f"T{n}", 100 if n > 40 else 50) for n in range(60)], "tender_id string, score int")
    queue = assessment.review_queue(flags, scores, size=20).collect()
    assert len({r.tender_id for r in queue}) == len(queue) and sum(r.reason == "boundary" for r in queue) == 10
    assert {r.reason for r in queue} == {"boundary", "disagreement", "novel"}
    tenders = spark.createDataFrame([(f"T{n}", "A", "Wnd", "awarded", date(2020, 1, 1), 1, 6e6 if n else 6e7, None) for n in range(12)], TENDERS + ", estimated_value_mkd double, actual_value_mkd double")
    got = {(r.tender_id, r.rule): r.severity for r in risk.alerts(flags, tenders, ("WND",)).collect()}
    assert got["T0", "single_bidder_high_value"] == "critical" and got["T1", "single_bidder_high_value"] == "medium"
    assert got["T1", "repeat_pattern"] == "critical" and got["T1", "watched_entity"] == "medium" and ("T1", "multiple_flags") not in got


def test_history_is_strictly_before(spark):
    t = [("T1", "A", "X", "awarded", date(2020, 1, 1), 2), ("T2", "A", "X", "awarded", date(2020, 1, 2), 1), ("T3", "A", "X", "awarded", date(2020, 1, 2), 1), ("T4", None, None, "open", None, None)]
    bids = [("T1", "X"), ("T1", "Y"), ("T2", "X"), ("T3", "X")]
    got = {r.tender_id: r for r in history.relationship_features(spark.createDataFrame(t, TENDERS), spark.createDataFrame(bids, "tender_id string, company_name string")).collect()}
    assert set(got) == {"T1", "T2", "T3", "T4"} and got["T1"].pair_wins == 0 and got["T1"].new_supplier == 1
    assert (got["T3"].pair_wins, got["T3"].pair_bids, got["T3"].market_share, got["T3"].institutions) == (2, 1, 1.0, 1) == (got["T2"].pair_wins, got["T2"].pair_bids, got["T2"].market_share, got["T2"].institutions)
    assert got["T4"].pair_wins == 0 and got["T4"].buyer_tenders == 0
