"""Findings of the fourth review."""

import heapq
import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from bidscope.operators import entities, follow_up, indicators, source_walks
from bidscope.plans import graph_queries, registry
from bidscope.sources.domain import DOMAIN_SQL

ORACLES = registry.oracle_sql()


def test_sequences_on_a_half_fall_to_the_side_of_their_sql(spark):
    sets = [(16, 17, 20, 30, 32, 32, 32), (2, 9, 29, 30, 34), (2, 7, 7, 9, 9, 17, 18), (6, 11, 13, 18, 23, 27, 38), (6, 7, 14, 19, 24, 28, 38), (4, 6, 10, 11, 36), (1, 2, 3)]
    rows = [(f"T{n}", f"CO-{i}", bid * 100000.0, i == 0) for n, bids in enumerate(sets) for i, bid in enumerate(bids)]
    bidders = spark.createDataFrame(rows, "tender_id string, company_name string, bid_amount_mkd double, is_winner boolean")
    out = {(r.tender_id, r.score, r.evidence) for r in indicators.price_sequence(bidders).collect()}
    arrow = bidders.toArrow()
    duck = duckdb.connect()
    duck.register("given", arrow)
    sql = ORACLES["i20_price_sequence"].removeprefix(DOMAIN_SQL)
    assert out == set(duck.execute(f"WITH bidders AS (FROM given) SELECT tender_id, score, evidence FROM ({sql}) z").fetchall())


def test_rates_on_a_half_are_rounded_as_their_sql_does(spark):
    day, counts = date(2000, 1, 1), [(640, 41), (640, 323), (3200, 201), (128, 1), (7, 2)]
    rows = [(f"T{b}-{n}", f"B{b}", day + timedelta(n == total), day + timedelta(30), 1.0 * n, 1 if n < single else 3, "closed", None, 0) for b, (total, single) in enumerate(counts) for n in range(total + 1)]
    tenders = spark.createDataFrame(rows, "tender_id string, procuring_entity string, publication_date date, closing_date date, estimated_value_mkd double, num_bidders int, status string, winner string, amendment_count int")
    out = {(r.tender_id, r.log_value, r.buyer_tenders, r.buyer_single_rate) for r in follow_up.batch_features(tenders).collect()}
    duck = duckdb.connect()
    duck.register("given", tenders.toArrow())
    sql = ORACLES["m9_batch_features"].removeprefix(DOMAIN_SQL)
    assert out == set(duck.execute(f"WITH tenders AS (FROM given) SELECT tender_id, log_value, buyer_tenders, buyer_single_rate FROM ({sql}) z").fetchall())


def _dijkstra(edges, source):
    near = {}
    for (a, b), w in edges.items():
        for s, d in ((a, b), (b, a)):
            near.setdefault(s, {})[d] = min(near.get(s, {}).get(d, float("inf")), 1 / w)
    far, heap = {}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in far:
            far[n] = d
            for to, length in near.get(n, {}).items():
                heapq.heappush(heap, (d + length, to))
    parent = {n: min((p for p in near.get(n, {}) if p in far and far[p] + near[p][n] == far[n]), default=None) for n in far}
    return {(source, n, far[n], None if n == source else parent[n]) for n in far}


def test_paths_need_no_job_for_each_hop(spark, monkeypatch):
    rng = random.Random(4)
    edges = {(f"{side}{rng.randrange(40)}", f"{side}{rng.randrange(40)}"): float(rng.choice([1, 1, 1, 2, 4])) for side in "ab" for _ in range(90)}
    edges |= {(f"z{i}", f"z{i + 1}"): 1.0 for i in range(60)} | {("z0", "z60"): 0.0101}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    asked = [f"{side}{i}" for side in "ab" for i in range(9)] + ["z0", "nowhere"]
    wrote, materialize = [], source_walks.materialize
    monkeypatch.setattr(source_walks, "materialize", lambda df, label: wrote.append(label) or materialize(df, label))
    out = source_walks.shortest_paths(df, spark.createDataFrame([(n,) for n in asked], "node string"), cells=200, most=5, edges_each=30)
    assert {tuple(r) for r in out.collect()} == set().union(*(_dijkstra(edges, n) for n in asked))
    assert len(wrote) < 10  # z60 is sixty hops from z0
    with pytest.raises(RuntimeError):
        source_walks.shortest_paths(df, spark.createDataFrame([("z0",)], "node string"), rounds=3, edges_each=30)


def test_betweenness_counts_paths_from_every_node(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted((f"{side}{rng.randrange(n)}", f"{side}{rng.randrange(n)}"))) for side, n in (("a", 30), ("b", 8)) for _ in range(n * 2)}
    pairs |= {("hub", f"leaf{i:04d}") for i in range(1100)}  # more nodes than from which pivots were drawn
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0) | {"hub": 1100 * 1099 / 2}
    for source in [n for n in near if n[0] in "ab"]:
        level, paths, order = {source: 0}, {source: 1.0}, [source]
        for n in order:
            for to in near[n]:
                if to not in level:
                    level[to], paths[to] = level[n] + 1, 0.0
                    order.append(to)
                if level[to] == level[n] + 1:
                    paths[to] += paths[n]
        gain = dict.fromkeys(order, 0.0)
        for n in reversed(order):
            for to in near[n]:
                if level[to] == level[n] - 1:
                    gain[to] += paths[to] / paths[n] * (1 + gain[n])
            want[n] += gain[n] / 2 if n != source else 0.0
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")
    got = {r.node: r.score for r in source_walks.betweenness(df, cells=30_000, edges_each=500).collect()}
    assert got == pytest.approx(want)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph_queries, "_network", lambda t: df)
        assert {r.node: r.score for r in graph_queries.QUERIES["g16_betweenness"](None).collect()} == pytest.approx(want, abs=1e-6)


def test_links_beyond_equal_titles_are_sought_only_where_these_leave_room(spark, monkeypatch):
    rng = random.Random(6)
    words = ("gear", "bolt", "blue gear", "gear blue", "blue bolt", "old blue gear")
    rows = [(f"T{n}", rng.choice(words), f"B{n % 3}", date(2000, 1, 1) + timedelta(rng.randrange(200)), 1000.0 + rng.randrange(400), rng.choice(("05000000", "05000100", "07000000")), rng.choice(("awarded", "closed"))) for n in range(240)]
    rows += [("T900", "gear", "B9", date(2000, 1, 1), 10.0, "05000000", "awarded"), ("T901", "gear", "B9", date(2001, 1, 1), 1000.0, "07000000", "closed"), ("T902", "old gear", "B9", date(2000, 1, 3), 10.0, "05000000", "closed")]
    tenders = spark.createDataFrame(rows, "tender_id string, title string, procuring_entity string, publication_date date, estimated_value_mkd double, cpv_code string, status string")
    side = lambda status: tenders.filter(F.col("status") == status).withColumnRenamed("tender_id", "id")
    kept, write = {}, entities.materialize
    monkeypatch.setattr(entities, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    out = {tuple(r) for r in entities.link_tenders(side("awarded"), side("closed")).collect()}
    assert ("T900", "T902", 115) in out
    duck = duckdb.connect()
    duck.register("given", tenders.toArrow())
    assert out == set(duck.execute(f"WITH tenders AS (FROM given) {ORACLES['j10_linked_tenders'].removeprefix(DOMAIN_SQL)}").fetchall())
    settled = {i for i, _, score in out if score > 115}
    assert settled and kept["link-open"].count() <= len({r[0] for r in rows if r[6] == "awarded"} - settled) < kept["link-left"].count()
