"""Registered queries of the graph operators; iterative ones without SQL are held against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.operators import graph as g
from bidscope.operators import source_walks as w
from bidscope.sources.domain import AS_OF, DOMAIN_SQL
from bidscope.workspace import materialize

D = "::DOUBLE"
WON = "status IN ('awarded', 'completed') AND winner IS NOT NULL AND winner <> ''"
_EDGES = "(SELECT a.company_name AS src, b.company_name AS dst, COUNT(*) AS weight, SUM(estimated_value_mkd) AS value, MIN(publication_date) AS first_seen, MAX(publication_date) AS last_seen FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name JOIN tenders t ON t.tender_id = a.tender_id GROUP BY 1, 2 HAVING COUNT(*) >= 2)"
_AWARDS = f"(SELECT procuring_entity AS src, winner AS dst, COUNT(*) AS weight, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} GROUP BY 1, 2)"


def _trade(t):
    """Customers and the suppliers of their orders: the largest graph that the tables hold."""
    o = t.raw("orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("src"))
    line = t.raw("lineitem").select("l_orderkey", F.concat(F.lit("S"), "l_suppkey").alias("dst"))
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _network(t):
    """Companies that bid together and buyers with the companies they award to: all edges."""
    own = t.written()
    pairs = g.co_bidding_edges(own.tenders, own.bidders).select("src", "dst", "weight")
    return materialize(pairs.unionByName(g.award_edges(own.tenders).select("src", "dst", "weight")), "network")


def _hundredths(t):
    """The nodes that paths are sought from: all customers whose number is divisible by 100."""
    return _trade(t).filter(F.substring("src", 2, 20).cast("long") % 100 == 0).select(F.col("src").alias("node")).distinct()


_TRADE = "(SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, COUNT(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
_UD = f"sp AS MATERIALIZED (SELECT src, dst, weight FROM {_TRADE} z), ud AS MATERIALIZED (SELECT src AS a, dst AS b FROM sp UNION SELECT dst, src FROM sp)"
_NET = f"""net AS MATERIALIZED (SELECT src, dst, weight FROM {_EDGES} a UNION ALL SELECT src, dst, weight FROM {_AWARDS} b),
nb AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM net UNION ALL SELECT dst, src FROM net) x WHERE a <> b),
dg AS (SELECT a AS node, COUNT(*) AS d FROM nb GROUP BY a),
tr AS (SELECT x.a AS node, COUNT(*) / 2.0::DOUBLE AS t FROM nb x JOIN nb y ON x.a = y.a AND x.b <> y.b JOIN nb z ON z.a = x.b AND z.b = y.b GROUP BY x.a),
rc AS (SELECT a AS node, a AS other FROM nb UNION SELECT rc.node, nb.b FROM rc JOIN nb ON rc.other = nb.a),
cp AS (SELECT COUNT(DISTINCT m) AS components FROM (SELECT node, MIN(other) AS m FROM rc GROUP BY node) x)"""


def _densities(edges):
    return g.community_edges(edges, g.communities(edges))


_ALL = {
    "g1_co_bidding_edges": (lambda t: g.co_bidding_edges(t.tenders, t.bidders), f"SELECT * FROM {_EDGES} e"),
    "g2_award_edges": (lambda t: g.award_edges(t.tenders), f"SELECT * FROM {_AWARDS} e"),
    "g3_partnership_edges": (lambda t: g.partnership_edges(t.tenders), f"SELECT src, dst, weight, value, ROUND(weight * 100.0{D} / awards, 4) AS share FROM (SELECT *, SUM(weight) OVER (PARTITION BY src) AS awards FROM {_AWARDS} e) x WHERE weight >= 3"),
    "g4_concentration_edges": (lambda t: g.concentration_edges(t.tenders, least_share=25.0), f"SELECT src, dst, value, spent, share FROM (SELECT *, ROUND(value * 100.0{D} / spent, 4) AS share FROM (SELECT *, SUM(value) OVER (PARTITION BY src) AS spent FROM {_AWARDS} e) x) y WHERE spent >= 1e6 AND share >= 25"),
    "g6_pair_features": (lambda t: g.pair_features(t.bidders), "SELECT a.company_name AS src, b.company_name AS dst, COUNT(*) AS together, ROUND(AVG(1 - ABS(a.bid_amount_mkd - b.bid_amount_mkd) / NULLIF(GREATEST(a.bid_amount_mkd, b.bid_amount_mkd), 0)), 6) AS bid_likeness, ROUND(AVG(CASE WHEN a.is_winner OR b.is_winner THEN 1 ELSE 0 END), 6) AS one_won FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name GROUP BY 1, 2"),
    "g8_decayed_edges": (lambda t: g.decayed(g.co_bidding_edges(t.tenders, t.bidders), AS_OF), f"SELECT src, dst, value, first_seen, last_seen, ROUND(weight * pow(0.5{D}, (DATE '2001-08-01' - last_seen) / 365), 9) AS weight FROM {_EDGES} e"),
    "g10_graph_statistics": (lambda t: g.graph_statistics(_network(t)), f", {_NET} SELECT nodes, edges, mean_degree, max_degree, sd_degree, clustering, components, ROUND(2.0{D} * edges / (nodes * (nodes - 1)), 6) AS density FROM (SELECT COUNT(*) AS nodes, CAST(SUM(d) / 2 AS BIGINT) AS edges, ROUND(AVG(d), 6) AS mean_degree, MAX(d) AS max_degree, ROUND(stddev_pop(d), 6) AS sd_degree, ROUND(AVG(CASE WHEN d > 1 THEN 2 * COALESCE(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM dg LEFT JOIN tr USING (node)) x, cp"),
    "g5_degrees": (lambda t: g.degrees(_trade(t)), f"SELECT node, COUNT(*) AS degree, SUM(weight) AS strength FROM (SELECT src AS node, weight FROM {_TRADE} a UNION ALL SELECT dst, weight FROM {_TRADE} b) x GROUP BY node"),
    "g11_connected_components": (lambda t: g.connected_components(_trade(t)), f", {_UD}, reach AS (SELECT a AS node, a AS other FROM ud UNION SELECT r.node, ud.b FROM reach r JOIN ud ON r.other = ud.a) SELECT node, MIN(other) AS component FROM reach GROUP BY node"),
    "g12_neighbourhood": (lambda t: g.neighbourhood(_trade(t), _hundredths(t)), f", {_UD}, walks AS (SELECT DISTINCT src AS source, src AS node, 0 AS depth FROM sp WHERE CAST(substr(src, 2) AS BIGINT) % 100 = 0 UNION SELECT w.source, ud.b, w.depth + 1 FROM walks w JOIN ud ON w.node = ud.a WHERE w.depth < 2) SELECT source, node, MIN(depth) AS depth FROM walks GROUP BY source, node"),
    "g14_shortest_paths": (lambda t: w.shortest_paths(_trade(t), _hundredths(t)).select("source", "node", F.round("distance", 9).alias("distance")), None),
    "g15_pagerank": (lambda t: g.pagerank(_trade(t), tolerance=1e-7).select("node", F.round("rank", 12).alias("rank")), None),
    "g16_betweenness": (lambda t: w.betweenness(_network(t)).select("node", F.round("score", 6).alias("score")), None),
    "g18_communities": (lambda t: g.communities(_network(t)), None),
    "g19_community_density": (lambda t: _densities(_network(t)), None),
    "g20_two_core": (lambda t: g.k_core(_network(t), 2), None),
    "g21_rotation_clusters": (lambda t: g.rotation_clusters(t.tenders, t.bidders), f"""SELECT companies, tenders, winners, changes, ratio, score, LEAST(100.0{D}, score + tenders * 2) AS confidence FROM (SELECT companies, ROUND(COUNT(DISTINCT winner) * 100.0{D} / len(string_split(companies, '|')), 6) AS score, COUNT(*) AS tenders, COUNT(DISTINCT winner) AS winners, COALESCE(SUM(CASE WHEN winner <> prev THEN 1 WHEN prev IS NOT NULL THEN 0 END), 0) AS changes, ROUND(COALESCE(SUM(CASE WHEN winner <> prev THEN 1 WHEN prev IS NOT NULL THEN 0 END), 0) / GREATEST(COUNT(*) - 1, 1), 6) AS ratio
      FROM (SELECT s.companies, t.winner, lag(winner) OVER (PARTITION BY companies ORDER BY publication_date, t.tender_id) AS prev FROM tenders t JOIN (SELECT tender_id, string_agg(company_name, '|' ORDER BY company_name) AS companies FROM bidders GROUP BY tender_id HAVING COUNT(*) >= 2) s ON s.tender_id = t.tender_id WHERE {WON}) x GROUP BY companies) y WHERE tenders >= 4 AND winners >= 2 AND ratio > 0.3 AND score >= 40"""),
    "g22_cover_clusters": (lambda t: g.cover_clusters(t.bidders), "SELECT winner, loser, n, ROUND(m, 6) AS mean, ROUND(s, 6) AS sd FROM (SELECT w.company_name AS winner, l.company_name AS loser, COUNT(*) AS n, AVG(l.bid_amount_mkd / w.bid_amount_mkd) AS m, stddev_samp(l.bid_amount_mkd / w.bid_amount_mkd) AS s FROM bidders w JOIN bidders l ON w.tender_id = l.tender_id WHERE w.is_winner AND NOT l.is_winner AND w.bid_amount_mkd > 0 AND l.bid_amount_mkd / w.bid_amount_mkd > 1.1 GROUP BY 1, 2) x WHERE n >= 3 AND m > 1.15 AND s < 0.3"),
    "g22_cover_clusters_30": (lambda t: g.cover_clusters(t.bidders, most_sd=30.0), "SELECT winner, loser, n, ROUND(m, 6) AS mean, ROUND(s, 6) AS sd FROM (SELECT w.company_name AS winner, l.company_name AS loser, COUNT(*) AS n, AVG(l.bid_amount_mkd / w.bid_amount_mkd) AS m, stddev_samp(l.bid_amount_mkd / w.bid_amount_mkd) AS s FROM bidders w JOIN bidders l ON w.tender_id = l.tender_id WHERE w.is_winner AND NOT l.is_winner AND w.bid_amount_mkd > 0 AND l.bid_amount_mkd / w.bid_amount_mkd > 1.1 GROUP BY 1, 2) x WHERE n >= 3 AND m > 1.15 AND s < 30"),
    "g23_market_allocation": (lambda t: g.market_allocation(t.tenders), f""", wn AS MATERIALIZED (SELECT category, winner, COUNT(DISTINCT procuring_entity) AS buyers FROM tenders WHERE {WON} AND category IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 2),
      bw AS MATERIALIZED (SELECT DISTINCT t.category, t.procuring_entity, t.winner FROM tenders t JOIN wn ON wn.category = t.category AND wn.winner = t.winner WHERE {WON}),
      mt AS (SELECT category, winner, COUNT(DISTINCT other) AS met FROM (SELECT p.category, p.winner, q.winner AS other FROM bw p JOIN bw q ON p.category = q.category AND p.procuring_entity = q.procuring_entity AND p.winner <> q.winner) x GROUP BY 1, 2)
      SELECT category, winner, buyers, rivals, COALESCE(met, 0) AS met, rivals - COALESCE(met, 0) AS never_met FROM (SELECT *, COUNT(*) OVER (PARTITION BY category) - 1 AS rivals FROM wn) r LEFT JOIN mt USING (category, winner) WHERE rivals > 0""".replace("t JOIN wn ON wn.category = t.category AND wn.winner = t.winner WHERE status IN ('awarded', 'completed') AND winner IS NOT NULL AND winner <> ''", "t JOIN wn ON wn.category = t.category AND wn.winner = t.winner WHERE t.status IN ('awarded', 'completed')")),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: (DOMAIN_SQL.replace("WITH bids0", "WITH RECURSIVE bids0", 1) + sql) for name, (_, sql) in _ALL.items() if sql}
