"""Registered queries of the market statistics, each with its SQL."""

from __future__ import annotations

from datetime import date

from bidscope.operators import market as m
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

AW = "status IN ('awarded', 'completed')"
WON = f"{AW} AND winner IS NOT NULL"
AS = "DATE '2001-08-01'"
D = "::DOUBLE"
_BAND = "CASE WHEN estimated_value_mkd IS NULL THEN 'unknown' " + " ".join(f"WHEN estimated_value_mkd < {t} THEN '{n}'" for t, n in m.BANDS) + " ELSE '10m and more' END"


def _top(key: str) -> str:
    return f"SELECT {key}, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated, ROUND(AVG(num_bidders), 4) AS mean_bidders FROM tenders WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY tenders DESC, {key} LIMIT 10"


def _per_group(group: str, key: str, k: int) -> str:
    return f"SELECT {group}, {key}, wins, value, place FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY wins DESC, value DESC, {key}) AS place FROM (SELECT {group}, {key}, COUNT(*) AS wins, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} AND {group} IS NOT NULL GROUP BY {group}, {key}) x) y WHERE place <= {k}"


_PANEL = """SELECT procuring_entity, COUNT(*) AS tenders, SUM(CASE WHEN status IN ('awarded', 'completed') THEN 1 ELSE 0 END) AS awarded, SUM(estimated_value_mkd) AS estimated, ROUND(AVG(num_bidders), 4) AS mean_bidders, ROUND(quantile_cont(num_bidders, 0.5), 4) AS median_bidders,
  SUM(CASE WHEN num_bidders = 1 THEN 1 ELSE 0 END) AS single_bids, SUM(CASE WHEN closing_date - publication_date < 7 THEN 1 ELSE 0 END) AS short_deadlines, ROUND(AVG(closing_date - publication_date), 4) AS mean_days, COUNT(DISTINCT winner) AS winners FROM tenders GROUP BY procuring_entity"""

_ALL = {
    "p1_market_totals": (lambda t: m.market_totals(t.tenders), f"SELECT COUNT(*) AS tenders, SUM(CASE WHEN status = 'open' THEN 1 ELSE 0 END) AS open, SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) AS awarded, SUM(estimated_value_mkd) AS estimated, SUM(actual_value_mkd) AS actual, ROUND(AVG(num_bidders), 4) AS mean_bidders, COUNT(DISTINCT procuring_entity) AS buyers, COUNT(DISTINCT winner) AS winners FROM tenders"),
    "p1_value_bands": (lambda t: m.by_value_band(t.tenders), f"SELECT {_BAND} AS band, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated, ROUND(AVG(num_bidders), 4) AS mean_bidders FROM tenders GROUP BY 1"),
    "p1_monthly_trend": (lambda t: m.monthly_trend(t.tenders, AS_OF), f"SELECT strftime(publication_date, '%Y-%m') AS month, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated, SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) AS awarded FROM tenders WHERE publication_date BETWEEN DATE '2000-08-01' AND {AS} GROUP BY 1"),
    "p1_top_categories": (lambda t: m.top_groups(t.tenders, "category"), _top("category")),
    "p1_top_buyers": (lambda t: m.top_groups(t.tenders, "procuring_entity"), _top("procuring_entity")),
    "p2_competitor_analysis": (lambda t: m.competitor_analysis(t.bidders), f"SELECT company_name, bids, wins, won_value, mean_bid, ROUND(wins * 100.0{D} / bids, 4) AS win_rate, ROUND(SUM(wins) OVER () * 100.0{D} / SUM(bids) OVER (), 4) AS market_win_rate FROM (SELECT company_name, COUNT(*) AS bids, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN is_winner THEN bid_amount_mkd END) AS won_value, ROUND(AVG(bid_amount_mkd), 4) AS mean_bid FROM bidders GROUP BY company_name) x"),
    "p4_category_trends": (lambda t: m.category_trends(t.tenders, AS_OF), f"SELECT category, now, before, value_now, ROUND((now - before) * 100.0{D} / NULLIF(before, 0), 4) AS growth FROM (SELECT category, SUM(CASE WHEN a < 365 THEN 1 ELSE 0 END) AS now, SUM(CASE WHEN a >= 365 THEN 1 ELSE 0 END) AS before, SUM(CASE WHEN a < 365 THEN estimated_value_mkd END) AS value_now FROM (SELECT *, {AS} - publication_date AS a FROM tenders) x WHERE a BETWEEN 0 AND 729 GROUP BY category) y"),
    "p4_category_top_winners": (lambda t: m.top_per_group(t.tenders, "category", "winner"), _per_group("category", "winner", 5)),
    "p63_buyer_top_winners": (lambda t: m.top_per_group(t.tenders, "procuring_entity", "winner", 3), _per_group("procuring_entity", "winner", 3)),
    "p5_supplier_strength": (lambda t: m.supplier_strength(t.tenders, t.bidders), f"""SELECT company_name, bids, wins, value, categories, buyers, strength, CASE WHEN strength >= 70 THEN 'strong' WHEN strength >= 40 THEN 'medium' ELSE 'weak' END AS tier, rank() OVER (ORDER BY strength DESC) AS place FROM (
      SELECT *, ROUND(LEAST(30.0{D}, wins * 100.0{D} / bids * 1.5) + LEAST(25.0{D}, wins * 2.0{D}) + LEAST(20.0{D}, value / 1e6) + LEAST(15.0{D}, categories * 3.0{D}) + LEAST(10.0{D}, buyers * 2.0{D}), 4) AS strength FROM (
      SELECT company_name, COUNT(*) AS bids, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins, COALESCE(SUM(CASE WHEN is_winner THEN bid_amount_mkd END), 0.0{D}) AS value, COUNT(DISTINCT CASE WHEN is_winner THEN category END) AS categories, COUNT(DISTINCT CASE WHEN is_winner THEN procuring_entity END) AS buyers
      FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id GROUP BY company_name) x) y"""),
    "p6_price_history": (lambda t: m.price_history(t.tenders, "1"), f"SELECT CAST(date_trunc('month', publication_date) AS DATE) AS period, COUNT(*) AS tenders, ROUND(AVG(estimated_value_mkd), 4) AS mean_estimate, ROUND(AVG(actual_value_mkd), 4) AS mean_actual, ROUND(AVG((estimated_value_mkd - actual_value_mkd) * 100.0{D} / estimated_value_mkd), 4) AS mean_discount FROM tenders WHERE {WON} AND cpv_code LIKE '1%' AND estimated_value_mkd > 0 AND actual_value_mkd IS NOT NULL GROUP BY 1"),
    "p6_price_trend": (lambda t: m.price_trend(t.tenders), f"SELECT category, ROUND((b - a) * 100.0{D} / NULLIF(a, 0), 4) AS change, CASE WHEN (b - a) * 100.0{D} / NULLIF(a, 0) > 5 THEN 'increasing' WHEN (b - a) * 100.0{D} / NULLIF(a, 0) < -5 THEN 'decreasing' WHEN b IS NOT NULL AND a IS NOT NULL THEN 'stable' END AS trend FROM (SELECT category, AVG(CASE WHEN h = 1 THEN actual_value_mkd END) AS a, AVG(CASE WHEN h = 2 THEN actual_value_mkd END) AS b FROM (SELECT *, ntile(2) OVER (PARTITION BY category ORDER BY publication_date, tender_id) AS h FROM tenders WHERE {WON} AND category IS NOT NULL AND actual_value_mkd IS NOT NULL) x GROUP BY category) y"),
    "p7_bid_advice": (lambda t: m.bid_advice(t.tenders), f"SELECT category, n, ROUND(md, 6) AS median, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(GREATEST(0.0{D}, md - COALESCE(sd, 0)), 6) AS aggressive, ROUND(md + COALESCE(sd, 0), 6) AS safe FROM (SELECT category, COUNT(*) AS n, quantile_cont(r, 0.5) AS md, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3, stddev_samp(r) AS sd FROM (SELECT category, actual_value_mkd / estimated_value_mkd AS r FROM tenders WHERE {WON} AND estimated_value_mkd > 0 AND actual_value_mkd IS NOT NULL AND category IS NOT NULL) x GROUP BY category) y"),
    "p8_item_benchmarks": (lambda t: m.item_benchmarks(t.items), "SELECT name, COUNT(*) AS n, MIN(unit_price) AS low, ROUND(AVG(unit_price), 6) AS mean, MAX(unit_price) AS high FROM items GROUP BY name HAVING COUNT(*) >= 2"),
    "p37_item_price_intelligence": (lambda t: m.item_price_intelligence(t.items), "SELECT name, COUNT(*) AS n, ROUND(quantile_cont(unit_price, 0.25), 6) AS q1, ROUND(quantile_cont(unit_price, 0.5), 6) AS median, ROUND(quantile_cont(unit_price, 0.75), 6) AS q3, COUNT(DISTINCT company_name) AS companies, COUNT(DISTINCT brand) AS brands, arg_min(company_name, (unit_price, company_name)) AS cheapest FROM items WHERE unit_price > 0 GROUP BY name HAVING COUNT(*) >= 5"),
    "p39_item_price_by_year": (lambda t: m.item_price_by_year(t.items), "SELECT year(offered_on) AS year, cpv_code, COUNT(*) AS lines, SUM(quantity) AS quantity, ROUND(SUM(unit_price * quantity) / SUM(quantity), 4) AS mean_price FROM items GROUP BY 1, 2"),
    "p42_item_bid_comparison": (lambda t: m.item_bid_comparison(t.items), "SELECT tender_id, name, COUNT(*) AS companies, arg_min(company_name, (price, company_name)) AS lowest, MIN(price) AS low_price, MAX(price) AS high_price FROM (SELECT tender_id, name, company_name, MIN(unit_price) AS price FROM items GROUP BY 1, 2, 3) x GROUP BY 1, 2 HAVING COUNT(*) > 1"),
    "p9_activity_feed": (lambda t: m.activity_feed(t.tenders, t.bidders), f"SELECT b.tender_id, company_name, closing_date, CASE WHEN is_winner THEN 'won' WHEN winner IS NOT NULL THEN 'lost' ELSE 'bid' END AS outcome, CASE WHEN estimated_value_mkd > 0 THEN ROUND((estimated_value_mkd - bid_amount_mkd) * 100.0{D} / estimated_value_mkd, 4) END AS discount FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id"),
    "p10_bidding_patterns": (lambda t: m.bidding_patterns(t.tenders, t.bidders), f"SELECT company_name, bids, categories, buyers, small, large, ROUND(m, 6) AS mean_ratio, ROUND(GREATEST(0.0{D}, 1 - COALESCE(sd / NULLIF(m, 0), 0) / 2), 6) AS consistency FROM (SELECT company_name, COUNT(*) AS bids, AVG(bid_amount_mkd / estimated_value_mkd) AS m, stddev_samp(bid_amount_mkd / estimated_value_mkd) AS sd, COUNT(DISTINCT category) AS categories, COUNT(DISTINCT procuring_entity) AS buyers, SUM(CASE WHEN estimated_value_mkd < 1e6 THEN 1 ELSE 0 END) AS small, SUM(CASE WHEN estimated_value_mkd >= 1e7 THEN 1 ELSE 0 END) AS large FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE estimated_value_mkd > 0 GROUP BY company_name) x"),
    "p12_head_to_head": (lambda t: m.head_to_head(t.bidders), "SELECT a.company_name AS company_a, b.company_name AS company_b, COUNT(*) AS together, SUM(CASE WHEN a.is_winner THEN 1 ELSE 0 END) AS a_wins, SUM(CASE WHEN b.is_winner THEN 1 ELSE 0 END) AS b_wins, SUM(CASE WHEN a.bid_amount_mkd < b.bid_amount_mkd THEN 1 ELSE 0 END) AS a_lower, ROUND(AVG(ABS(a.bid_amount_mkd - b.bid_amount_mkd) / NULLIF(GREATEST(a.bid_amount_mkd, b.bid_amount_mkd), 0)), 6) AS mean_gap FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name GROUP BY 1, 2"),
    "p74_price_competitiveness": (lambda t: m.price_competitiveness(t.bidders), "SELECT company_name, COUNT(*) AS bids, ROUND(AVG((v - mn) * 100 / mn), 6) AS from_mean, ROUND(AVG((v - lo) * 100 / lo), 6) AS from_low, SUM(CASE WHEN v = lo THEN 1 ELSE 0 END) AS lowest, SUM(CASE WHEN v = hi THEN 1 ELSE 0 END) AS highest, ROUND(AVG(rank), 6) AS mean_rank FROM (SELECT company_name, rank, bid_amount_mkd AS v, AVG(bid_amount_mkd) OVER w AS mn, MIN(bid_amount_mkd) OVER w AS lo, MAX(bid_amount_mkd) OVER w AS hi, COUNT(*) OVER w AS n FROM bidders WHERE bid_amount_mkd > 0 WINDOW w AS (PARTITION BY tender_id)) x WHERE n > 1 GROUP BY company_name"),
    "p58_market_share": (lambda t: m.market_share(t.tenders), f"SELECT category, winner, wins, value, ROUND(wins * 100.0{D} / SUM(wins) OVER w, 4) AS wins_share, ROUND(value * 100.0{D} / SUM(value) OVER w, 4) AS value_share FROM (SELECT category, winner, COUNT(*) AS wins, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} AND category IS NOT NULL GROUP BY 1, 2) x WINDOW w AS (PARTITION BY category)"),
    "p75_buyer_panel": (lambda t: m.buyer_panel(t.tenders), _PANEL),
    "p77_buyer_suspicions": (lambda t: m.buyer_suspicions(t.tenders), f"""SELECT * FROM (SELECT p.procuring_entity, COALESCE(top_wins >= 3 AND top_wins * 100.0{D} / all_wins > 50, FALSE) AS dominant_winner, single_bids * 100.0{D} / tenders > 30 AS many_single_bids, short_deadlines * 100.0{D} / tenders > 20 AS many_short_deadlines FROM ({_PANEL}) p
      LEFT JOIN (SELECT procuring_entity, MAX(w) AS top_wins, SUM(w) AS all_wins FROM (SELECT procuring_entity, winner, COUNT(*) AS w FROM tenders WHERE {WON} GROUP BY 1, 2) x GROUP BY 1) y ON p.procuring_entity = y.procuring_entity) z WHERE dominant_winner OR many_single_bids OR many_short_deadlines"""),
    "p25_sector_statistics": (lambda t: m.sector_statistics(t.tenders), f"SELECT substr(cpv_code, 1, 2) AS division, COUNT(*) AS tenders, COUNT(DISTINCT winner) AS winners, ROUND(MIN(actual_value_mkd), 4) AS low, ROUND(AVG(actual_value_mkd), 4) AS mean, ROUND(quantile_cont(actual_value_mkd, 0.5), 4) AS median, ROUND(MAX(actual_value_mkd), 4) AS high, ROUND(AVG(num_bidders), 4) AS mean_bidders FROM tenders WHERE {AW} AND cpv_code IS NOT NULL GROUP BY 1"),
    "p18_seasonality": (lambda t: m.seasonality(t.tenders), "SELECT month, tenders, estimated, top_category FROM (SELECT month(publication_date) AS month, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated FROM tenders GROUP BY 1) a LEFT JOIN (SELECT month, category AS top_category FROM (SELECT month(publication_date) AS month, category, row_number() OVER (PARTITION BY month(publication_date) ORDER BY COUNT(*) DESC, category) AS p FROM tenders WHERE category IS NOT NULL GROUP BY 1, 2) x WHERE p = 1) b USING (month)"),
    "p67_closing_soon": (lambda t: m.closing_soon(t.tenders, date(1998, 6, 1)), "SELECT tender_id, closing_date, closing_date - DATE '1998-06-01' AS days_left, CASE WHEN closing_date - DATE '1998-06-01' <= 7 THEN 'urgent' WHEN closing_date - DATE '1998-06-01' <= 14 THEN 'soon' ELSE 'later' END AS urgency FROM tenders WHERE status = 'open' AND closing_date - DATE '1998-06-01' BETWEEN 0 AND 30"),
    "c10_expired_closing": (lambda t: m.upcoming_status(t.tenders, date(1998, 6, 1)), "SELECT CASE WHEN status = 'open' AND closing_date < DATE '1998-06-01' THEN 'closed' ELSE status END AS status, COUNT(*) AS tenders FROM tenders GROUP BY 1"),
    "p40_similar_tenders": (lambda t: m.similar_tenders(t.tenders), f"SELECT tender_id, similar_id, place, gap FROM (SELECT a.tender_id, b.tender_id AS similar_id, ABS(a.actual_value_mkd - b.actual_value_mkd) AS gap, row_number() OVER (PARTITION BY a.tender_id ORDER BY ABS(a.actual_value_mkd - b.actual_value_mkd), b.tender_id) AS place FROM tenders a JOIN tenders b ON a.cpv_code = b.cpv_code AND a.procuring_entity = b.procuring_entity AND a.tender_id <> b.tender_id WHERE a.{AW} AND a.actual_value_mkd IS NOT NULL AND a.winner IS NOT NULL AND b.{AW} AND b.actual_value_mkd IS NOT NULL AND b.winner IS NOT NULL) x WHERE place <= 3"),
    "p40_category_deviation": (lambda t: m.category_deviation(t.tenders), f"SELECT tender_id, ROUND((v - (s - v) / (n - 1)) * 100 / NULLIF((s - v) / (n - 1), 0), 4) AS deviation FROM (SELECT tender_id, actual_value_mkd AS v, SUM(actual_value_mkd) OVER w AS s, COUNT(*) OVER w AS n FROM tenders WHERE {WON} AND actual_value_mkd IS NOT NULL AND cpv_code IS NOT NULL WINDOW w AS (PARTITION BY cpv_code)) x WHERE n > 1"),
    "p41_missed_opportunities": (lambda t: m.missed_opportunities(t.tenders, t.bidders), f"SELECT company_name, COUNT(*) AS missed, SUM(estimated_value_mkd) AS missed_value FROM (SELECT DISTINCT company_name, cpv_code FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE is_winner) o JOIN tenders t USING (cpv_code) WHERE t.{AW} AND winner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bidders x WHERE x.tender_id = t.tender_id AND x.company_name = o.company_name) GROUP BY company_name"),
    "p38_supplier_ranking": (lambda t: m.supplier_ranking(t.tenders, t.bidders), f"""SELECT company_name, wins, value, place, share, top_category, top_procuring_entity FROM (SELECT company_name, wins, value, row_number() OVER (ORDER BY value DESC, company_name) AS place, ROUND(value * 100.0{D} / SUM(value) OVER (), 4) AS share FROM (SELECT company_name, COUNT(*) AS wins, SUM(bid_amount_mkd) AS value FROM bidders WHERE is_winner GROUP BY 1) x) r
      LEFT JOIN (SELECT company_name, string_agg(category, ',' ORDER BY p) AS top_category FROM (SELECT company_name, category, row_number() OVER (PARTITION BY company_name ORDER BY COUNT(*) DESC, category) AS p FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE is_winner AND category IS NOT NULL GROUP BY 1, 2) c WHERE p <= 3 GROUP BY 1) c USING (company_name)
      LEFT JOIN (SELECT company_name, string_agg(procuring_entity, ',' ORDER BY p) AS top_procuring_entity FROM (SELECT company_name, procuring_entity, row_number() OVER (PARTITION BY company_name ORDER BY COUNT(*) DESC, procuring_entity) AS p FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE is_winner GROUP BY 1, 2) c WHERE p <= 3 GROUP BY 1) e USING (company_name)"""),
    "p72_yearly_wins": (lambda t: m.yearly_wins(t.tenders), f"SELECT winner, year, wins, value, wins - lag(wins) OVER w AS change, SUM(wins) OVER (PARTITION BY winner ORDER BY year) AS running FROM (SELECT winner, year(publication_date) AS year, COUNT(*) AS wins, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} GROUP BY 1, 2) x WINDOW w AS (PARTITION BY winner ORDER BY year)"),
    "p72_buyer_relationships": (lambda t: m.new_relationships(t.tenders), f"SELECT procuring_entity, winner, COUNT(*) AS awards, MIN(publication_date) AS first, MAX(publication_date) AS last, SUM(actual_value_mkd) AS value, MAX(publication_date) - MIN(publication_date) AS days FROM tenders WHERE {WON} GROUP BY 1, 2 HAVING COUNT(*) >= 2"),
    "o8_all_facets": (
        lambda t: m.faceted(t.tenders, ["co-1", "NATION_1", "steel"], statuses=["awarded", "closed"], procedures=["Open", "QualificationSystem", "SimplifiedOpenProcedure"], cpv_prefix="1", low=5e5, high=9e6, published=(date(1994, 1, 1), date(1998, 12, 31)), closing=(date(1994, 2, 1), None)).select("tender_id", "title", "winner", "closing_date"),
        """SELECT tender_id, title, winner, closing_date FROM tenders WHERE regexp_matches(lower(concat_ws(chr(1), title, procuring_entity, category, winner, cpv_code)), 'co-1|nation_1|steel') AND status IN ('awarded', 'closed')
      AND procedure_type IN ('Open', 'QualificationSystem', 'SimplifiedOpenProcedure') AND starts_with(cpv_code, '1') AND estimated_value_mkd BETWEEN 5e5 AND 9e6 AND publication_date BETWEEN DATE '1994-01-01' AND DATE '1998-12-31' AND closing_date >= DATE '1994-02-01'""",
    ),
    "o8_faceted_search": (lambda t: m.keyword_search(t.tenders, ["plate", "gear"], 1e6, 9e6), "SELECT tender_id, title, category, estimated_value_mkd FROM tenders WHERE (lower(concat_ws(' ', title, category)) LIKE '%plate%' OR lower(concat_ws(' ', title, category)) LIKE '%gear%') AND estimated_value_mkd BETWEEN 1e6 AND 9e6"),
    "o3_keyset_page": (lambda t: m.page(t.tenders, (date(1998, 6, 1), "T5")), "SELECT tender_id, publication_date, estimated_value_mkd FROM tenders WHERE publication_date < DATE '1998-06-01' OR publication_date = DATE '1998-06-01' AND tender_id > 'T5' ORDER BY publication_date DESC, tender_id LIMIT 20"),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + sql for name, (_, sql) in _ALL.items()}
