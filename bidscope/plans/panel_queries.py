"""Registered queries of the panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidscope.functions import cleaning as c
from bidscope.functions import text as x
from bidscope.operators import panels as p
from bidscope.plans.detector_queries import FLAGS_SQL, flag_tables
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

D = "::DOUBLE"
WON = "status IN ('awarded', 'completed') AND winner IS NOT NULL AND winner <> ''"


def _searches(t):
    return t.raw("nation").select(F.col("n_nationkey").alias("search_id"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("cpv_prefix"), (F.col("n_regionkey") * 1e6).alias("low"), (F.col("n_regionkey") * 1e6 + 3e6).alias("high"))


def _prefs(t):
    """A user per nation."""
    k = F.col("n_nationkey")
    n = t.raw("nation").join(t.raw("part"), F.col("p_partkey") == k + 1)
    return n.select(k.alias("user_id"), F.col("p_type").alias("sector"), F.concat(F.lpad((k + 1).cast("string"), 2, "0"), F.lit("00")).alias("cpv4"), F.concat("n_name", F.lit("|")).alias("buyer"), F.lit(3e6).alias("budget"))


def _trend(unit):
    return lambda t: p.trend(t.tenders, unit), f"SELECT CAST(date_trunc('{unit}', publication_date) AS DATE) AS period, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated, SUM(actual_value_mkd) AS actual FROM tenders GROUP BY 1"


_ALL = {
    "p19_status_counts": (lambda t: p.status_counts(t.tenders), "SELECT 'status' AS grain, status AS value, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated FROM tenders GROUP BY status UNION ALL SELECT 'category', category, COUNT(*), SUM(estimated_value_mkd) FROM tenders GROUP BY category UNION ALL SELECT 'procedure', procedure_type, COUNT(*), SUM(estimated_value_mkd) FROM tenders GROUP BY procedure_type UNION ALL SELECT 'all', NULL, COUNT(*), SUM(estimated_value_mkd) FROM tenders"),
    "p19_weekly_trend": _trend("week"),
    "p20_monthly_statistics": _trend("month"),
    "p15_quarterly_history": _trend("quarter"),
    "p16_value_changes": (lambda t: p.value_changes(t.amendments), "SELECT tender_id, COUNT(*) AS changes, string_agg(CAST(amendment_date AS VARCHAR), ',' ORDER BY amendment_date, n) AS dates FROM amendments WHERE field_changed = 'estimated_value_mkd' GROUP BY 1"),
    "p11_company_profile": (lambda t: p.company_profile(t.tenders, t.bidders), "SELECT company_name, COUNT(*) AS bids, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN is_winner THEN bid_amount_mkd END) AS value, MIN(publication_date) AS first_bid, MAX(publication_date) AS last_bid, SUM(CASE WHEN is_winner AND num_bidders = 1 THEN 1 ELSE 0 END) AS single_bid_wins, SUM(CASE WHEN is_winner AND closing_date - publication_date < 7 THEN 1 ELSE 0 END) AS short_deadline_wins, ROUND(AVG((bid_amount_mkd - estimated_value_mkd) * 100 / NULLIF(estimated_value_mkd, 0)), 4) AS from_estimate FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id GROUP BY 1"),
    "p57_rivals": (lambda t: p.rivals(t.bidders), f"SELECT company_name, rival, together, our_wins, their_wins, ROUND(together * 100.0{D} / n, 4) AS share FROM (SELECT m.*, n, row_number() OVER (PARTITION BY m.company_name ORDER BY together DESC, rival) AS place FROM (SELECT a.company_name, b.company_name AS rival, COUNT(*) AS together, SUM(CASE WHEN a.is_winner THEN 1 ELSE 0 END) AS our_wins, SUM(CASE WHEN b.is_winner THEN 1 ELSE 0 END) AS their_wins FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name <> b.company_name GROUP BY 1, 2) m JOIN (SELECT company_name, COUNT(DISTINCT tender_id) AS n FROM bidders GROUP BY 1) c ON c.company_name = m.company_name) x WHERE place <= 3"),
    "p78_bidder_overlap": (lambda t: p.overlap_of_smaller(t.bidders), f"SELECT a.company_name AS a, b.company_name AS b, COUNT(*) AS shared, ROUND(COUNT(*) * 100.0{D} / LEAST(MIN(x.n), MIN(y.n)), 4) AS overlap FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name JOIN (SELECT company_name, COUNT(*) AS n FROM bidders GROUP BY 1) x ON x.company_name = a.company_name JOIN (SELECT company_name, COUNT(*) AS n FROM bidders GROUP BY 1) y ON y.company_name = b.company_name GROUP BY 1, 2 HAVING COUNT(*) >= 2"),
    "p62_best_months": (lambda t: p.best_months(t.tenders, AS_OF, 4), f"SELECT month(publication_date) AS month, COUNT(*) AS awards, ROUND(AVG(num_bidders), 4) AS mean_bidders, ROUND(AVG(actual_value_mkd), 4) AS mean_value FROM tenders WHERE {WON} AND publication_date >= DATE '1997-08-01' GROUP BY 1"),
    "p61_price_recommendation": (lambda t: p.price_recommendation(t.items, "plate"), "SELECT COUNT(*) AS n, MIN(unit_price) AS low, ROUND(quantile_cont(unit_price, 0.25), 6) AS q1, ROUND(AVG(unit_price), 6) AS mean, ROUND(quantile_cont(unit_price, 0.75), 6) AS q3, MAX(unit_price) AS high FROM items WHERE lower(name) LIKE '%plate%' AND unit_price > 0"),
    "p34_item_price_trend": (lambda t: p.item_price_trend(t.items), "SELECT name, ROUND((b - a) * 100 / NULLIF(a, 0), 4) AS change FROM (SELECT name, AVG(CASE WHEN h = 1 THEN unit_price END) AS a, AVG(CASE WHEN h = 3 THEN unit_price END) AS b FROM (SELECT *, ntile(3) OVER (PARTITION BY name ORDER BY offered_on, tender_id, company_name, unit_price) AS h FROM items) x GROUP BY name) y"),
    "p27_product_search": (lambda t: p.product_search(t.items, "gear"), "SELECT name, year(offered_on) AS year, COUNT(*) AS lines, COUNT(DISTINCT company_name) AS companies, MIN(unit_price) AS low, MAX(unit_price) AS high FROM items WHERE lower(name) LIKE '%gear%' GROUP BY 1, 2"),
    "c15_imputed_prices": (lambda t: p.imputed_prices(t.items, F.col("quantity") > 40), "SELECT source, COUNT(*) AS items, ROUND(AVG(price), 4) AS mean_price FROM (SELECT CASE WHEN q IS NOT NULL THEN 'offer' WHEN cn >= 3 THEN 'category' WHEN nn >= 2 THEN 'name' ELSE 'none' END AS source, COALESCE(q, CASE WHEN cn >= 3 THEN cm END, CASE WHEN nn >= 2 THEN nm END) AS price FROM (SELECT q, AVG(q) OVER c AS cm, COUNT(q) OVER c AS cn, AVG(q) OVER n AS nm, COUNT(q) OVER n AS nn FROM (SELECT *, CASE WHEN quantity <= 40 THEN unit_price END AS q FROM items) a WINDOW c AS (PARTITION BY cpv_code), n AS (PARTITION BY name)) b) d GROUP BY 1"),
    "p52_platform_statistics": (lambda t: p.platform_statistics(t.raw("events"), t.raw("documents")), "SELECT * FROM (SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) AS events, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events) a, (SELECT COUNT(*) AS documents, SUM(n_chars) AS characters FROM documents) b"),
    "p43_funnel": (lambda t: p.funnel(t.raw("events")), "SELECT COUNT(v) AS viewed, SUM(CASE WHEN c > v THEN 1 ELSE 0 END) AS clicked, SUM(CASE WHEN c > v AND b > c THEN 1 ELSE 0 END) AS bought FROM (SELECT MIN(CASE WHEN event_type = 'view' THEN ts END) AS v, MIN(CASE WHEN event_type = 'click' THEN ts END) AS c, MIN(CASE WHEN event_type = 'purchase' THEN ts END) AS b FROM events GROUP BY user_id) x"),
    "p45_usage_limits": (lambda t: p.usage_limits(t.raw("events"), 3), "SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS events FROM events GROUP BY 1, 2 HAVING COUNT(*) > 3"),
    "p53_engagement": (lambda t: p.engagement(t.raw("events")), "SELECT user_id, SUM(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 2 ELSE 1 END) AS points, COUNT(*) AS events FROM events GROUP BY 1 ORDER BY points DESC, user_id LIMIT 20"),
    "o9_saved_search_counts": (lambda t: p.saved_search_counts(t.tenders, _searches(t)), "SELECT n_nationkey AS search_id, COUNT(tender_id) AS matches FROM nation LEFT JOIN tenders ON starts_with(cpv_code, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0')) AND estimated_value_mkd BETWEEN n_regionkey * 1e6 AND n_regionkey * 1e6 + 3e6 GROUP BY 1"),
    "p51_unmatched_winners": (lambda t: p.unmatched_winners(t.tenders, t.raw("supplier").select(F.concat(F.lit("CO-"), (F.col("s_suppkey") % 3).cast("string")).alias("name")).distinct()), f"SELECT winner AS name, COUNT(*) AS wins, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} AND winner NOT IN (SELECT 'CO-' || (s_suppkey % 3) FROM supplier) GROUP BY 1"),
    "x24_document_anomalies": (lambda t: p.document_anomalies(t.raw("documents"), F.floor(F.col("doc_id") / 10)), "SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS tender, COUNT(*) AS documents, SUM(CASE WHEN length(text) < 100 THEN 1 ELSE 0 END) AS tiny, COUNT(*) - COUNT(DISTINCT text) AS repeated, CAST(LEAST(100, SUM(CASE WHEN length(text) < 100 THEN 1 ELSE 0 END) * 10 + (COUNT(*) - COUNT(DISTINCT text)) * 20) AS INTEGER) AS points FROM documents GROUP BY 1"),
    "r23_snapshot_differences": (lambda t: p.snapshot_differences(t.tenders.withColumn("winner", F.when(F.substring("tender_id", -1, 1) != "4", F.col("winner"))), t.tenders.withColumn("title", F.when(F.substring("tender_id", -1, 1) == "2", F.lit("another thing")).otherwise(F.col("title"))), "tender_id", ["title", "winner"]).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'title' AS field, 'changed' AS kind, COUNT(*) AS n FROM tenders WHERE tender_id LIKE '%2' AND 1 - levenshtein(lower(title), 'another thing') / GREATEST(length(title), 13) < 0.8 UNION ALL SELECT 'winner', 'filled', COUNT(*) FROM tenders WHERE tender_id LIKE '%4' AND winner IS NOT NULL UNION ALL SELECT 'title', 'filled', COUNT(*) FROM tenders WHERE tender_id LIKE '%2' AND title IS NULL HAVING COUNT(*) > 0"),
    "p70_compare_companies": (lambda t: p.compare_companies(t.tenders, ["CO-1", "CO-2", "CO-5"]), f"SELECT winner, year(publication_date) AS year, COUNT(*) AS wins, SUM(actual_value_mkd) AS value, COUNT(DISTINCT category) AS categories, COUNT(DISTINCT procuring_entity) AS buyers FROM tenders WHERE {WON} AND winner IN ('CO-1', 'CO-2', 'CO-5') GROUP BY 1, 2"),
    "g7_bipartite_edges": (lambda t: p.bipartite_edges(t.tenders, t.bidders), "SELECT company_name AS src, tender_id AS dst, CASE WHEN is_winner THEN 'won' ELSE 'bid_on' END AS kind FROM bidders UNION ALL SELECT tender_id, procuring_entity, 'procured_by' FROM tenders"),
    "p47_personal_ranking": (lambda t: p.open_pool(t.tenders, _prefs(t)), f"""SELECT user_id, tender_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, tender_id) AS place FROM (
      SELECT n_nationkey AS user_id, tender_id, ROUND(LEAST(1.0{D}, 0.3{D} + CASE WHEN category = p_type THEN 0.25{D} ELSE 0 END + CASE WHEN substr(cpv_code, 1, 4) = c4 THEN 0.2{D} ELSE 0 END + CASE WHEN contains(procuring_entity, n_name || '|') THEN 0.2{D} ELSE 0 END + CASE WHEN estimated_value_mkd <= 3e6 THEN 0.1{D} ELSE 0 END), 4) AS score
      FROM tenders JOIN (SELECT *, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '00' AS c4 FROM nation JOIN part ON p_partkey = n_nationkey + 1) u ON category = p_type OR substr(cpv_code, 1, 4) = c4 OR contains(procuring_entity, n_name || '|') WHERE status NOT IN ('awarded', 'completed')) x) y WHERE place <= 5"""),
    "w3_winner_changes": (lambda t: t.tenders.filter("winner is not null").select("tender_id", (F.col("winner") != F.lag("winner").over(Window.partitionBy("procuring_entity").orderBy("publication_date", "tender_id"))).alias("changed")), "SELECT tender_id, winner <> lag(winner) OVER (PARTITION BY procuring_entity ORDER BY publication_date, tender_id) AS changed FROM tenders WHERE winner IS NOT NULL"),
    "w7_latest_per_buyer": (lambda t: t.tenders.groupBy("procuring_entity").agg(F.max_by("tender_id", F.struct("publication_date", "tender_id")).alias("tender_id")), "SELECT procuring_entity, arg_max(tender_id, (publication_date, tender_id)) AS tender_id FROM tenders GROUP BY 1"),
    "a4_percentiles": (lambda t: t.tenders.filter("category is not null").groupBy("category").agg(*[F.round(F.percentile("estimated_value_mkd", q), 4).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)]), "SELECT category, ROUND(quantile_cont(estimated_value_mkd, 0.25), 4) AS p25, ROUND(quantile_cont(estimated_value_mkd, 0.5), 4) AS p50, ROUND(quantile_cont(estimated_value_mkd, 0.75), 4) AS p75, ROUND(quantile_cont(estimated_value_mkd, 0.9), 4) AS p90 FROM tenders WHERE category IS NOT NULL GROUP BY 1"),
    "a2_distinct_sums": (lambda t: t.tenders.groupBy("procuring_entity").agg(F.count_distinct("winner", "category").alias("pairs"), F.sum_distinct("estimated_value_mkd").alias("distinct_sum"), F.sum("estimated_value_mkd").alias("full_sum")), "SELECT procuring_entity, COUNT(DISTINCT CASE WHEN winner IS NOT NULL AND category IS NOT NULL THEN (winner, category) END) AS pairs, SUM(DISTINCT estimated_value_mkd) AS distinct_sum, SUM(estimated_value_mkd) AS full_sum FROM tenders GROUP BY 1"),
    "j3_never_won": (lambda t: t.bidders.select("tender_id").distinct().join(t.bidders.filter("is_winner").select("tender_id"), "tender_id", "left_anti"), "SELECT DISTINCT tender_id FROM bidders b WHERE NOT EXISTS (SELECT 1 FROM bidders w WHERE w.tender_id = b.tender_id AND w.is_winner)"),
    "o6_all_parties": (lambda t: t.tenders.select(F.col("procuring_entity").alias("name")).union(t.bidders.select("company_name")).distinct(), "SELECT procuring_entity AS name FROM tenders UNION SELECT company_name FROM bidders"),
    "p56_win_rates": (lambda t: p.win_rates(t.bidders), f"SELECT company_name, COUNT(*) AS bids, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins, ROUND(SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) * 100.0{D} / COUNT(*), 4) AS win_rate FROM bidders GROUP BY 1 HAVING COUNT(*) >= 5"),
    "p64_top_tenders": (lambda t: p.top_tenders(t.tenders), "SELECT tender_id, procuring_entity, estimated_value_mkd, winner FROM tenders ORDER BY estimated_value_mkd DESC NULLS LAST, tender_id LIMIT 20"),
    "c14_good_products": (lambda t: t.items.groupBy(c.good_product(F.col("name"), strict=True).alias("good")).agg(F.count(F.lit(1)).alias("items")), "SELECT length(trim(name)) >= 10 AS good, COUNT(*) AS items FROM items GROUP BY 1"),
    "x9_snippets": (lambda t: t.raw("documents").select("doc_id", F.sha2(F.encode(x.snippet(F.coalesce("text", F.lit("")), "tion", before=20, length=60), "UTF-8"), 256).alias("snippet")), "SELECT doc_id, sha256(substr(text, GREATEST(1, CAST(instr(lower(text), 'tion') AS INTEGER) - 20), 60)) AS snippet FROM documents"),
    "r5_flag_search": (lambda t: (lambda own, flags: p.flag_search(flags, own.tenders, severities=("critical", "high"), flag_type="short_deadline", least_score=60))(*flag_tables(t)), None),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + sql for name, (_, sql) in _ALL.items() if sql}
ORACLES["r5_flag_search"] = FLAGS_SQL + "SELECT f.tender_id, score, types, procuring_entity, winner FROM (SELECT tender_id, MAX(CASE WHEN severity IN ('critical', 'high') THEN score END) AS score, string_agg(DISTINCT flag_type, ',' ORDER BY flag_type) AS types, bool_or(flag_type = 'short_deadline') AS hit FROM flags GROUP BY 1) f JOIN tenders t ON t.tender_id = f.tender_id WHERE hit AND score >= 60"
