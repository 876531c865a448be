"""Release import, assessment, panels and text measures on small tables of their own."""

from datetime import date

from pyspark.sql import functions as F

from bidscope.functions import text
from bidscope.operators import assessment, entities, panels
from bidscope.sources import ocds
from bidscope.workspace import fresh_path

RELEASES = [
    '{"ocid": "ocds-x-12345678-1234-1234-1234-123456789abc", "date": "2021-02-03", "buyer": {"name": "B"}, "tender": {"title": "t", "value": {"amount": 10, "currency": "EUR"}, "items": [{"classification": {}}, {"classification": {"id": "33000000"}}], "lots": [{"id": "1", "value": {"amount": 5}}, {"id": "2"}]}, "awards": [{"suppliers": [{"name": "W"}], "value": {"amount": 7}}, {"value": {"amount": 1, "currency": "EUR"}}], "bids": {"details": [{"value": {"amount": 7}, "tenderers": [{"name": "W"}, {"name": "L"}], "relatedLots": ["1"]}]}}',
    '{"ocid": "no-uuid", "awards": [{"suppliers": [{"name": "A"}, {"name": null}], "value": {"amount": 2}}]}',
    '{"ocid": "bare"}',
]


def releases(spark):
    path = fresh_path(spark, "json")
    spark.createDataFrame([(r,) for r in RELEASES], "value string").write.text(path)
    return ocds.read_releases(spark, path)


def test_releases(spark):
    r = releases(spark)
    t = {x.ocid: x for x in ocds.tenders(r).collect()}
    one = t["ocds-x-12345678-1234-1234-1234-123456789abc"]
    assert (one.uuid, one.estimated_value_mkd, one.actual_value_mkd, one.winner, one.cpv_code, one.publication_date, one.has_lots) == ("12345678-1234-1234-1234-123456789abc", 615.0, 61.5, "W", "33000000", date(2021, 2, 3), True)
    assert t["no-uuid"].uuid is None and t["no-uuid"].winner == "A" and t["bare"].winner is None and not t["bare"].has_lots
    b = {(x.company_name, x.bid_amount_mkd, x.is_winner, x.lot_id) for x in ocds.bidders(r).collect()}
    assert b == {("W", 7.0, True, "1"), ("L", 7.0, False, "1"), ("A", 2.0, True, None)}
    assert [(x.lot_number, x.estimated_value_mkd) for x in ocds.lots(r).orderBy("pos").collect()] == [("1", 5.0), ("2", None)]
    stored = spark.createDataFrame([("no-uuid", None), ("bare", 4.0)], "ocid string, actual_value_mkd double")
    assert {x.ocid: x.actual_value_mkd for x in ocds.repaired_values(stored, r).collect()} == {"no-uuid": 2.0, "bare": 4.0}


def test_bootstrap_brackets_the_index(spark):
    flags = spark.createDataFrame([("T1", "single_bidder", 50), ("T1", "procedure_type", 60), ("T2", "identical_bids", 75)], "tender_id string, flag_type string, score int")
    got = {r.tender_id: r for r in assessment.bootstrap_interval(flags, draws=100).collect()}
    for r in got.values():
        assert 0 <= r.ci_lower <= r.cri <= r.ci_upper <= 100 and r.ci_upper - r.ci_lower < 20
    again = {r.tender_id: r for r in assessment.bootstrap_interval(flags, draws=100).collect()}
    assert got == again


def test_scores_are_evaluated(spark):
    rows = spark.createDataFrame([(0.95, 1), (0.85, 1), (0.55, 0), (0.15, 0)], "score double, label int")
    sweep = {round(r.threshold, 2): r for r in assessment.threshold_sweep(rows, steps=10).collect()}
    assert (sweep[0.9].precision, sweep[0.9].recall) == (1.0, 0.5) and sweep[0.8].f1 == 1.0 and sweep[0.1].precision == 0.5
    assert {r.bin: (r.n, r.share) for r in assessment.calibration(rows).collect()} == {9: (1, 1.0), 8: (1, 1.0), 5: (1, 0.0), 1: (1, 0.0)}
    assert abs(assessment.conformal_quantile(rows) - 0.55) < 1e-9


def test_uncertainty_matrix(spark):
    df = spark.createDataFrame([(5.0, 0.9), (5.0, 0.1), (20.0, 0.9), (20.0, 0.1), (40.0, 0.9)], "w double, c double")
    assert [r[0] for r in df.select(assessment.uncertainty(F.col("w"), F.col("c"))).collect()] == ["low", "medium", "medium", "high", "high"]


def test_links_and_names(spark):
    s = "id string, procuring_entity string, title string, publication_date date, estimated_value_mkd double, cpv_code string"
    left = spark.createDataFrame([("l", "B", "Same", date(2020, 1, 1), 100.0, "33")], s)
    right = spark.createDataFrame([("r1", "B", "same", date(2020, 1, 3), 100.0, "33"), ("r2", "B", "other", date(2020, 1, 1), 100.0, "33"), ("r3", "C", "same", date(2020, 1, 1), 100.0, "33")], s)
    assert [tuple(r) for r in entities.link_tenders(left, right).collect()] == [("l", "r1", 165)]  # 100 + 30 + 20 + 15
    names = spark.createDataFrame([("Gradba DOO",), ("none",)], "name string")
    registry = spark.createDataFrame([("ГРАДБА ДООЕЛ",), ("Gradba",)], "name string")
    assert [tuple(r) for r in entities.match_companies(names, registry).collect()] == [("Gradba DOO", "Gradba", 1)]


def test_tables_context_and_copies(spark):
    tables = spark.createDataFrame([(1, [["Name", "Quantity", "Price"], ["bolt", "2", "1.5"], ["", "1", "1"], ["nut", "x", None]]), (2, [["other"], ["cell"]])], "doc_id int, cells array<array<string>>")
    got = [tuple(r) for r in text.table_rows_to_items(tables).orderBy("row").collect()]
    assert got == [(1, 0, "bolt", 2.0, 1.5), (1, 2, "nut", None, None)]
    hits = spark.createDataFrame([(1, "a" * 40, 0.9), (1, "a" * 40, 0.5), (1, "b" * 40, 0.8), (1, "c" * 400, 0.7)], "query_id int, passage string, similarity double")
    assert [(r.place, r.passage[0]) for r in text.context_window(hits, budget=30).orderBy("place").collect()] == [(1, "a"), (2, "b")]
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "One, two; three four five six seven!"), (3, "a wholly different line of words here")], "doc_id int, text string")
    assert {r.doc_id: r.copied for r in text.copied_share(docs).collect()} == {1: 1.0, 2: 1.0}


def test_funnel_and_differences(spark):
    from datetime import datetime as d

    events = spark.createDataFrame([(1, "view", d(2024, 1, 1)), (1, "click", d(2024, 1, 2)), (1, "purchase", d(2024, 1, 3)), (2, "click", d(2024, 1, 1)), (2, "view", d(2024, 1, 2))], "user_id int, event_type string, ts timestamp")
    assert tuple(panels.funnel(events).first()) == (2, 1, 1)
    old = spark.createDataFrame([(1, "a long title here", None), (2, "same", "x")], "id int, title string, winner string")
    new = spark.createDataFrame([(1, "something else now", "w"), (2, "Same ", "x")], "id int, title string, winner string")
    assert {(r.id, r.field, r.kind) for r in panels.snapshot_differences(old, new, "id", ["title", "winner"]).collect()} == {(1, "title", "changed"), (1, "winner", "filled")}
