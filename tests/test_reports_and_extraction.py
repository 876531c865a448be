"""Company reports, entities and contacts, names in both scripts, against plain Python and planted rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bidscope.functions import extraction as x
from bidscope.functions.cleaning import cpv_name
from bidscope.operators import company_reports as c
from bidscope.operators import feature_sets as fs
from bidscope.operators import panels as p
from bidscope.operators import risk as r

AS_OF = date(2020, 6, 30)
TENDERS = "tender_id string, title string, category string, procuring_entity string, cpv_code string, publication_date date, closing_date date, status string, estimated_value_mkd double, actual_value_mkd double, winner string, num_bidders long"
BIDDERS = "tender_id string, company_name string, is_winner boolean, disqualified boolean, bid_amount_mkd double, rank int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_top_sums_are_those_of_all_items(spark, seed):
    """Short heads force several rounds; many sums are equal."""
    rng = random.Random(seed)
    lists = {(f"k{k}", f"i{i:02d}"): (rng.choice([1, 1, 1, 2, 3, 40]), float(rng.randrange(3))) for k in range(6) for i in range(60) if rng.random() < 0.6}
    sets = {f"s{s}": rng.sample([f"k{k}" for k in range(7)], rng.randrange(1, 6)) for s in range(12)}
    want = []
    for s, keys in sets.items():
        sums = {}
        for (key, item), (n, v) in lists.items():
            if key in keys:
                a, b = sums.get(item, (0, 0.0))
                sums[item] = (a + n, b + v)
        best = sorted(((-n, -v, i) for i, (n, v) in sums.items() if n >= 2))[:4]
        want += [(s, i, -n, -v, at) for at, (n, v, i) in enumerate(best, 1)]
    left = spark.createDataFrame([(s, k) for s, keys in sets.items() for k in keys], "set_id string, key string")
    right = spark.createDataFrame([(*key, *value) for key, value in lists.items()], "key string, item string, n long, value double")
    assert rows(c.top_sums(left, right, 4, least=2, first=5)) == sorted(want, key=repr)


def test_top_sums_of_nothing(spark):
    none = spark.createDataFrame([], "set_id string, key string")
    lists = spark.createDataFrame([], "key string, item string, n long, value double")
    assert c.top_sums(none, lists, 3).count() == 0
    assert c.top_sums(spark.createDataFrame([("s", "k")], none.schema), lists, 3).count() == 0


def market(spark, seed, n=300):
    """Tenders of few codes, one of which has most; one company bids nearly always; some rows lack code, date, buyer or name."""
    rng = random.Random(seed)
    tenders, bids = [], []
    for i in range(n):
        code = None if rng.random() < 0.05 else rng.choice(["11000000"] * 6 + ["22000000", "33000000-1", "44000000", "55000000", "66000000"])
        day = None if rng.random() < 0.03 else AS_OF - timedelta(days=rng.randrange(500))
        closing = None if rng.random() < 0.1 else AS_OF - timedelta(days=rng.randrange(60))
        buyer = None if rng.random() < 0.05 else f"B{rng.randrange(14)}"
        who = {f"C{k}" for k in range(6) if rng.random() < (0.9 if k == 0 else 0.15)}
        winner = rng.choice(sorted(who)) if who and rng.random() < 0.8 else None
        tenders.append((f"T{i:03d}", "title", "cat", buyer, code, day, closing, rng.choice(["awarded", "closed", "open"]), float(rng.randrange(9)), None if rng.random() < 0.2 else float(rng.randrange(9)), winner, len(who)))
        bids += [(f"T{i:03d}", w, w == winner, False, 5.0, 1) for w in sorted(who)]
    bids += [("T000", None, True, None, None, None), ("T-gone", "C1", True, False, 1.0, 1)]
    return tenders, bids, spark.createDataFrame(tenders, TENDERS), spark.createDataFrame(bids, BIDDERS)


def segment_of(tenders, bids):
    of = {t[0]: t for t in tenders}
    counts = {}
    for tid, who, won, *_ in bids:
        t = of.get(tid)
        if who and t and t[4]:
            n, v = counts.setdefault(who, {}).get(t[4][:8], (0, 0.0))
            counts[who][t[4][:8]] = (n + 1, v + ((t[9] or 0.0) if won else 0.0))
    return {who: [k for k, _ in sorted(per.items(), key=lambda e: (-e[1][0], -e[1][1], e[0]))[:5]] for who, per in counts.items()}


@pytest.mark.parametrize("seed", range(2))
def test_missed_tenders_of_a_company_that_bids_on_nearly_all(spark, seed):
    tenders, bids, t, b = market(spark, seed)
    own = {(tid, who) for tid, who, *_ in bids}
    want = []
    for who, codes in segment_of(tenders, bids).items():
        missed = [x for x in tenders if x[4] and x[4][:8] in codes and x[5] and x[5] >= AS_OF - timedelta(days=200) and x[7] in ("awarded", "closed") and (x[0], who) not in own]
        missed.sort(key=lambda m: (m[6] is None, -(m[6] or AS_OF).toordinal(), m[0]))
        want += [(who, m[0], m[4][:8], m[6], (m[9] or m[8] or 0.0), at) for at, m in enumerate(missed[:3], 1)]
    assert rows(c.report_missed(t, b, AS_OF, days=200, k=3)) == sorted(want, key=repr)


def test_expected_volume_and_buyers_of_the_segment(spark):
    tenders, bids, t, b = market(spark, 5)
    want, best = [], {}
    for who, codes in segment_of(tenders, bids).items():
        seen = [x for x in tenders if x[4] and x[4][:8] in codes and x[5] and AS_OF - timedelta(days=365) <= x[5] <= AS_OF]
        months = {(x[5].year, x[5].month) for x in seen}
        mean = len(seen) / len(months) if months else 0
        want.append((who, int(mean * 0.5), int(mean), int(mean * 1.5), "medium" if len(months) >= 6 else "low"))
        per = {}
        for x in seen:
            if x[3]:
                n, v = per.get(x[3], (0, 0.0))
                per[x[3]] = (n + 1, v + (x[9] or 0.0))
        best[who] = [k for k, _ in sorted(per.items(), key=lambda e: (-e[1][0], -e[1][1], e[0]))[:10]]
    assert rows(c.report_expected(t, b, AS_OF)) == sorted(want, key=repr)
    got = {}
    for row in c.report_buyer_map(t, b, AS_OF).orderBy("company_name", "place").collect():
        got.setdefault(row.company_name, []).append(row.procuring_entity)
    assert got == best


def test_reports_of_empty_tables(spark):
    t, b = spark.createDataFrame([], TENDERS), spark.createDataFrame([], BIDDERS)
    for part in (c.report_year(t, b, AS_OF), c.report_codes(t, b), c.report_buyers(t, b), c.report_rivals(t, b, AS_OF), c.report_missed(t, b, AS_OF), c.report_expected(t, b, AS_OF), c.report_buyer_map(t, b, AS_OF)):
        assert part.count() == 0


def test_entities_of_each_type_with_their_confidence(spark):
    text = "Договор за 1.200,00 денари и 500 ден. од 3.4.1985, 2020-01-02 и 5 Март 2021; ЕМБС: 1234567, МК1234567890123 2020, MK1234567890123. Член 5 став 2, Службен весник на РМ бр. 24/2019\nво Скопје, IBAN MK07 3000 0000 0000 35"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ништо")], "doc_id long, text string")
    got = {(row.entity_type, row.entity): row.confidence for row in x.entity_mentions(docs).collect() if row.doc_id == 1}
    assert x.entity_mentions(docs).filter("doc_id > 1").count() == 0
    assert got["MONEY", "1.200,00 денари"] == 0.98 and got["MONEY", "500 ден."] == 0.95
    assert got["DATE", "3.4.1985"] == 0.66 or got["DATE", "3.4.1985"] == 0.67
    assert got["DATE", "2020-01-02"] == 0.95 and got["DATE", "5 Март 2021"] == 0.95
    assert got["TAX_ID", "ЕМБС: 1234567"] == 0.98 and ("TAX_ID", "MK1234567890123") in got and ("TAX_ID", "МК1234567890123") not in got
    assert got["LEGAL_REF", "Член 5 став 2"] == 0.85 and ("LEGAL_REF", "Службен весник на РМ бр. 24/2019") in got
    assert got["GPE", "Скопје"] == 0.8 and got["IBAN", "MK07 3000 0000 0000 35"] == 0.97


def test_contacts_leave_out_what_only_looks_like_one(spark):
    text = "CPV: 45000000-7, A.B@Firm.mk, x@example.com, logo@firm.png, (02) 312-345, +389 70 123 456, 12345678; добитник: Алфа Градба ДООЕЛ. Contractor: Beta Works Ltd"
    docs = spark.createDataFrame([(1, text), (2, None), (2, "")], "doc_id long, text string")
    got = {}
    for row in x.document_contacts(docs).collect():
        got.setdefault(row.kind, set()).add(row.value)
    assert got["code"] == {"45000000-7"} and got["email"] == {"a.b@firm.mk"}
    assert {"02312345", "+38970123456"} - got["phone"] == {"02312345"}, "eight digits are a code"
    assert "12345678" not in got["phone"]
    assert {"Алфа Градба ДООЕЛ", "Beta Works Ltd"} <= got["company"]


def test_long_texts_are_read_whole(spark):
    text = "а " * 600_000 + "во Охрид, 12.12.2012 "
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {(row.entity_type, row.entity) for row in x.entity_mentions(docs).collect()} == {("GPE", "Охрид"), ("DATE", "12.12.2012")}


def test_alerts_in_both_scripts_with_short_words_competitors_and_open_bounds(spark):
    t = spark.createDataFrame(
        [("a", "Набавка на возила", None, "Општина", None, None, None, "open", None, None, "Алфа ДОО", 1), ("b", "it опрема", None, "X", "48000000", None, None, "open", 50.0, None, None, 1), ("c", "within limits", None, "X", "48000000", None, None, "open", 5.0, None, None, 1)], TENDERS
    )
    s = spark.createDataFrame(
        [(1, "vozila", None, None, None, None, "алфа"), (2, "it", None, None, 10.0, None, None), (3, None, "4800", "x", None, 20.0, None), (4, None, None, None, 0.0, 9.0, None)],
        "alert_id long, keyword string, cpv4 string, buyer string, low double, high double, competitor string",
    )
    assert rows(r.match_alerts(t, s)) == [("a", 1, 50), ("b", 2, 45), ("b", 3, 55), ("c", 3, 75)]


def test_flags_are_found_by_names_in_latin_and_cyrillic(spark):
    flags = spark.createDataFrame([("a", "short_deadline", "high", 70), ("b", "short_deadline", "high", 70)], "tender_id string, flag_type string, severity string, score int")
    t = spark.createDataFrame([("a", "Општина Битола", "Алфа"), ("b", "Opstina Ohrid", None)], "tender_id string, procuring_entity string, winner string")
    find = lambda **names: [row.tender_id for row in p.flag_search(flags, t, severities=("high",), flag_type="short_deadline", least_score=60, **names).collect()]
    assert find(buyer="bitola") == ["a"] and find(buyer="OHRID") == ["b"] and find(buyer="bitola", winner="alfa") == ["a"] and find(winner="beta") == []


def test_division_names(spark):
    codes = spark.createDataFrame([("45000000-7",), ("99",), (None,), ("",)], "code string")
    assert [row[0] for row in codes.select(cpv_name(F.col("code"))).collect()] == ["Construction work", None, None, None]


def test_competition_of_tenders_with_and_without_bids(spark):
    day = date(2020, 1, 1)
    t = spark.createDataFrame([(f"T{i}", "", "c", "B", None, day + timedelta(days=i), None, "awarded", None, None, "x" if i else None, 2 if i else 0) for i in range(3)], TENDERS)
    b = spark.createDataFrame([("T1", "x", True, False, 30.0, 2), ("T1", "y", False, True, 10.0, 1), ("T2", "x", True, False, None, 1), ("T2", "z", False, None, None, None)], BIDDERS)
    got = {row.tender_id: row for row in fs.competition_feature_set(t, b).collect()}
    assert got["T0"].no_bidders == 1 and got["T0"].new_bidders_count == 0 and got["T0"].bidder_clustering_score == 0
    assert got["T1"].market_concentration_hhi == 6250 and got["T1"].new_bidders_count == 2 and got["T1"].winner_not_lowest == 1 and got["T1"].disqualification_rate == 0.5
    assert got["T2"].new_bidders_count == 1 and got["T2"].new_bidders_ratio == 0.5 and got["T2"].bidder_clustering_score == 1 and got["T2"].market_concentration_hhi == 0
