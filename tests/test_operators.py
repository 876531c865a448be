"""Branches that the tables don't reach, and operators without SQL, on small tables of their own."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bidscope.functions import cleaning, text
from bidscope.operators import detectors, entities, graph, risk
from bidscope.streaming import incremental
from bidscope.workspace import fresh_path

T = "tender_id string, procuring_entity string, winner string, publication_date date, closing_date date, contract_signing_date date, estimated_value_mkd double, actual_value_mkd double, num_bidders int, status string, procedure_type string, evaluation_method string, amendment_count int, last_amendment_date date"
B = "tender_id string, company_name string, bid_amount_mkd double, disqualified boolean, is_winner boolean"


def tender(i, *, buyer="B", winner="W", day=date(2020, 1, 6), closing=None, signed=None, value=600_000.0, actual=None, bidders=1, status="awarded", kind="Open", method="lowest price", amended=0, last=None):
    return (f"T{i}", buyer, winner, day, closing, signed, value, actual, bidders, status, kind, method, amended, last)


def found(df):
    return {r.tender_id: (r.score, r.severity) for r in df.collect()}


def test_single_bidder_ladder_and_ties(spark):
    rows = [tender(i, day=date(2020, 1, 1 + i // 2)) for i in range(6)] + [tender(9, value=6e6, buyer="C"), tender(10, value=500_000.0), tender(11, value=None), tender(12, bidders=None), tender(13, winner=None)]
    got = found(detectors.single_bidder(spark.createDataFrame(rows, T)))
    assert [got[f"T{i}"] for i in range(6)] == [(40, "low")] * 3 + [(60, "high")] * 3
    assert got["T9"] == (60, "high") and not {"T10", "T11", "T12", "T13"} & set(got)


def test_repeat_winner_flags_the_latest(spark):
    rows = [tender(i, day=date(2020, 1, 1 + i)) for i in range(9)] + [tender(20, winner="X")]
    assert found(detectors.repeat_winner(spark.createDataFrame(rows, T))) == {"T8": (80, "critical")}


def test_rotation_alternates(spark):
    rows = [tender(i, winner="AB"[i % 2], day=date(2020, 1, 1 + i), value=2e6) for i in range(10)]
    assert found(detectors.bid_rotation(spark.createDataFrame(rows, T))) == {"T9": (90, "critical")}


def test_splitting_losers_and_clusters(spark):
    t = spark.createDataFrame([tender(i, day=date(2020, 1, 1 + i), value=850_000.0) for i in range(12)], T)
    b = spark.createDataFrame([r for i in range(12) for r in ((f"T{i}", "W", 1.0, False, True), (f"T{i}", "L", 2.0, False, False))], B)
    assert set(found(detectors.contract_splitting(t)).values()) == {(90, "critical")} and detectors.contract_splitting(t).count() == 12
    assert found(detectors.bid_clustering(t, b)) == {"T11": (80, "critical")}
    assert set(found(detectors.professional_loser(t, b)).values()) == {(60, "high")}


def test_empty_tables(spark):
    t, b = spark.createDataFrame([], T), spark.createDataFrame([], B)
    flags = detectors.all_flags(t, b)
    assert flags.count() == 0 and detectors.risk_index(flags).count() == 0


def test_risk_index_rounding(spark):
    flags = spark.createDataFrame([("T1", "single_bidder", 45), ("T1", "procedure_type", 60), ("T1", "procedure_type", 35), ("T2", "single_bidder", 100), ("T2", "identical_bids", 100)], "tender_id string, flag_type string, score int")
    assert {r.tender_id: (r.cri, r.risk_level) for r in detectors.risk_index(flags).collect()} == {"T1": (61, "high"), "T2": (100, "critical")}


EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 4.0), ("x", "y", 1.0), ("y", "x", 3.0), ("z", "z", 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double")


def test_graph_basics(edges):
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert {r.node: r.triangles for r in graph.triangles(edges).collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r.node for r in graph.k_core(edges, 2).collect()} == {"a", "b", "c"}
    s = graph.graph_statistics(edges).first()
    assert (s.nodes, s.edges, s.max_degree) == (6, 5, 3)


def test_paths_ranks_and_betweenness(spark, edges):
    one = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (round(r.distance, 6), r.parent) for r in graph.shortest_paths(edges, one).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, "a"), "c": (1.0, "a"), "d": (1.25, "c")}
    ranks = {r.node: r.rank for r in graph.pagerank(edges, rounds=60).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["a"]
    all_nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    scores = {r.node: r.score for r in graph.betweenness(edges.filter("src in ('a','b','c')"), all_nodes).collect()}
    assert scores.get("c") == 2.0 and not scores.get("a") and not scores.get("d")
    assert {r.node: r.depth for r in graph.neighbourhood(edges, one, hops=2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_long_chains_are_walked_to_their_ends(spark):
    """Paths of more than ten hops, with a lighter path of more hops, and scores over more than six hops."""
    names = [f"n{i:02d}" for i in range(13)]
    chain = spark.createDataFrame([(a, b, 10.0) for a, b in zip(names, names[1:], strict=False)] + [("n00", "n12", 0.5)], "src string, dst string, weight double")
    one = spark.createDataFrame([("n00",)], "node string")
    got = {r.node: (round(r.distance, 6), r.parent) for r in graph.shortest_paths(chain, one).collect()}
    assert len(got) == 13 and got["n12"] == (1.2, "n11")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(chain, one, rounds=3)
    line = chain.filter("weight > 1")
    scores = {r.node: r.score for r in graph.betweenness(line, graph.drawn_pivots(line)).collect()}
    assert scores == {n: float(i * (12 - i)) for i, n in enumerate(names)}
    with pytest.raises(RuntimeError):
        graph.k_core(line, 2, rounds=2)


def test_pivots_are_drawn_over_all_nodes(spark):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}", 1.0) for i in range(30)], "src string, dst string, weight double")
    assert graph.drawn_pivots(edges).count() == 60
    few = {r.node for r in graph.drawn_pivots(edges, exact_up_to=10, draws=((50, 20), (10, 5))).collect()}
    assert len(few) == 20 and {n[0] for n in few} == {"a", "b"}
    star = spark.createDataFrame([("m", f"b{i}", 1.0) for i in range(4)], "src string, dst string, weight double")
    leaf = spark.createDataFrame([("b0",)], "node string")
    assert {r.node: r.score for r in graph.betweenness(star, leaf).collect()}["m"] == 3 / 2 * 5


def test_communities_follow_weight(edges):
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert len({got["x"], got["y"]}) <= 2 and set(got) == set("abcdxy")


def test_dates_amounts_and_scripts(spark):
    cases = [("05.03.2021", date(2021, 3, 5)), ("5 март 2021", date(2021, 3, 5)), ("2021-03-05", date(2021, 3, 5)), ("05/03/2021", date(2021, 3, 5)), ("денес", date(2024, 1, 2)), ("вчера", date(2024, 1, 1)), ("nothing", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want date")
    assert all(r.got == r.want for r in df.select("want", cleaning.parse_date(F.col("t"), date(2024, 1, 2)).alias("got")).collect())
    amounts = [("1.234,56", 1234.56), ("1,234.56 MKD", 1234.56), ("from 100 to 200", 100.0), ("1.234.567", 1234567.0), ("12,5", 12.5), ("1,234,567", 1234567.0), ("none", None), ("99999999999999", None)]
    df = spark.createDataFrame(amounts, "t string, want double")
    assert [(r.t, r.got) for r in df.select("t", cleaning.parse_amount(F.col("t")).alias("got")).collect()] == amounts
    names = spark.createDataFrame([("Njegosh",), ("Жито",)], "n string")
    assert [r[0] for r in names.select(cleaning.search_variants(F.col("n"))).collect()] == [["Njegosh", "његош"], ["Жито"]]


def test_validation_and_changes(spark):
    rows = [("T1", "ab", "a description", "B", 5.0, date(2020, 1, 2), date(2020, 1, 1)), (None, "title", None, None, 1.0, None, None), ("T2", None, None, None, -1.0, None, None)]
    good, bad = cleaning.validate_tenders(spark.createDataFrame(rows, "tender_id string, title string, description string, procuring_entity string, estimated_value_mkd double, publication_date date, closing_date date"))
    got = {r.tender_id: (r.title, r.estimated_value_mkd, r.issues) for r in good.collect()}
    assert got == {"T1": ("a description", 5.0, ["title", "dates out of order"]), "T2": ("Tender T2", None, ["title", "negative value"])} and bad.count() == 1
    old = spark.createDataFrame([("a", "1", 2), ("b", "1", 1), ("c", None, 1)], "tender_id string, content_hash string, scrape_count int")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "tender_id string, content_hash string")
    assert {r.tender_id: (r.change, r.scrape_count) for r in cleaning.classify_changes(old, new).collect()} == {"a": ("unchanged", 3), "b": ("updated", 2), "c": ("updated", 2), "d": ("new", 1)}


def test_similar_names_and_accounts(spark):
    names = spark.createDataFrame([("green garden hose",), ("garden hose green",), ("steel bolt",)], "name string")
    assert [(r.a, r.b, r.similarity) for r in text.similar_names(names).collect()] == [("garden hose green", "green garden hose", 1.0)]
    accounts = spark.createDataFrame(
        [(1, "ann@x.com"), (2, "ann+a@x.com"), (3, "ann7@x.com"), (4, "anna@x.com"), (5, "ann@y.com"), (6, "alice@z.com"), (7, "blice@z.com"), (8, "xalice@z.com"), (9, "malicex@z.com")], "id int, email string"
    )
    got = {r.id: (r.base_class, r.base_size, r.plain_class, r.plain_size, r.near) for r in entities.duplicate_accounts(accounts).collect()}
    assert got == {
        1: (1, 2, 1, 3, 1), 2: (1, 2, 1, 3, 1), 3: (3, 1, 1, 3, 1), 4: (4, 1, 4, 1, 3), 5: (5, 1, 5, 1, 0),
        6: (6, 1, 6, 1, 3), 7: (7, 1, 7, 1, 2), 8: (8, 1, 8, 1, 3), 9: (9, 1, 9, 1, 2),
    }


def test_implausible_years_are_null(spark):
    df = spark.createDataFrame([("05.03.1999",), ("05.03.2051",), ("2050-12-31",)], "t string")
    assert [r[0] for r in df.select(cleaning.parse_date(F.col("t"), date(2024, 1, 2))).collect()] == [None, None, date(2050, 12, 31)]


def test_text_measures(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five! Mail me@x.org on 2024-01-05."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in text.complexity(docs).collect()}
    assert got[1].sentences == 4 and got[2].words == got[3].words == 0 and got[2].mean_word is None
    assert {(r.entity_type, r.entity) for r in text.extract_entities(docs).collect()} == {("EMAIL", "me@x.org"), ("DATE", "2024-01-05")}
    chunks = text.sentence_chunks(docs, chunk_words=3).orderBy("chunk").collect()
    assert [c.text for c in chunks] == ["One two. Three four five!", "Mail me@x.org on 2024-01-05."]


def test_change_points(spark):
    flat = [("flat", i, 1.0) for i in range(30)]
    step = [("step", i, 0.0 if i < 15 else 10.0) for i in range(30)]
    few = [("few", i, float(i)) for i in range(4)]
    got = risk.change_points(spark.createDataFrame(flat + step + few, "k string, o int, v double"), "k", "o", "v").collect()
    assert {r.key for r in got} == {"step"} and {r.direction for r in got} == {"up", "down"}


def test_psi_of_equal_sets_is_zero(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert risk.psi(df, df, "v").agg(F.sum("psi")).first()[0] == 0


def test_stream_goes_on_from_its_checkpoint(spark):
    folder, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    from datetime import datetime as d

    read = lambda: spark.readStream.schema("ts timestamp, k string").parquet(folder)
    spark.createDataFrame([(d(2024, 1, 1, 0), "a"), (d(2024, 1, 1, 1), "a"), (d(2024, 1, 1, 1), "b")], "ts timestamp, k string").write.parquet(folder)
    first = incremental.drain(incremental.unique_alerts(read(), ["k"]), out=out, checkpoint=state)
    assert sorted(r.k for r in first.collect()) == ["a", "b"]
    spark.createDataFrame([(d(2024, 1, 1, 2), "a"), (d(2024, 1, 1, 2), "c")], "ts timestamp, k string").write.mode("append").parquet(folder)
    second = incremental.drain(incremental.unique_alerts(read(), ["k"]), out=out, checkpoint=state)
    assert sorted(r.k for r in second.collect()) == ["a", "b", "c"]


def test_new_rows_are_evaluated_once(spark):
    folder, target, state = (fresh_path(spark, n) for n in ("in", "alerts", "state"))
    stream = lambda: spark.readStream.schema("id int").parquet(folder)
    spark.createDataFrame([(1,), (2,)], "id int").write.parquet(folder)
    incremental.evaluate_new_rows(stream(), lambda df: df.filter("id > 1"), target, ["id"], state)
    spark.createDataFrame([(2,), (3,)], "id int").write.mode("append").parquet(folder)
    incremental.evaluate_new_rows(stream(), lambda df: df.filter("id > 1"), target, ["id"], state)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [2, 3]
