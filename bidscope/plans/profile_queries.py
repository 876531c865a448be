"""Registered queries of profiles and rankings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.operators import profiles as p
from bidscope.plans.detector_queries import FLAGS_SQL, flag_tables
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

D = "::DOUBLE"
WON = "status IN ('awarded', 'completed') AND winner IS NOT NULL AND winner <> ''"
DAY = "DATE '2001-08-01'"


def _countries(t):
    return t.raw("nation").select(F.col("n_name").alias("country"))


def _category(t):
    """The category that comes first by name."""
    return t.raw("part").agg(F.min("p_type")).first()[0]


def _leads(t):
    sums = t.bidders.groupBy("company_name").agg(F.count(F.lit(1)).alias("bids"), F.count_if("is_winner").alias("wins"))
    users = t.raw("events").select("user_id").distinct()
    each = users.withColumn("company_name", F.concat(F.lit("CO-"), (F.col("user_id") % 7).cast("string")))
    return p.scored_leads(each.join(sums, "company_name"), t.raw("events").filter("event_type <> 'signup' or event_id % 40 = 0"), least=12)


def _interests(t):
    kinds = t.tenders.filter("category is not null").select("category").distinct()
    return kinds.select(F.concat(F.lit("fan of "), "category").alias("user_id"), F.col("category").alias("sector"))


def _contacts(t):
    s = t.raw("supplier")
    k = F.col("s_suppkey")
    mails = F.explode(F.array(*[F.struct((k * n % 7).alias("confidence"), F.lit(n == 2).alias("role_based"), F.concat(F.lit(f"m{n}-"), k).alias("email")) for n in (1, 2, 3)]))
    return p.best_contacts(s.select(k.alias("company_id"), mails.alias("m")).select("company_id", "m.*"), s.filter("s_suppkey % 4 = 0").select(F.concat(F.lit("m3-"), "s_suppkey").alias("email")))


def _listed(name, column, by):
    return f"SELECT winner, string_agg({column}, ',' ORDER BY place) AS {name} FROM ({by}) x WHERE place <= 3 GROUP BY 1"


_ALL = {
    "p3_top_competitors": (lambda t: p.competitors(t.bidders, t.tenders, _category(t)), """
    , j AS (SELECT b.* FROM bidders b JOIN tenders USING (tender_id) WHERE category = (SELECT MIN(p_type) FROM part)),
    per AS (SELECT company_name, COUNT(*) AS bids, COUNT(*) FILTER (WHERE is_winner) AS wins, SUM(CASE WHEN is_winner THEN bid_amount_mkd END) AS value FROM j GROUP BY 1)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY wins DESC, bids DESC, company_name) AS INTEGER) AS place FROM per) x WHERE place <= 10
    UNION ALL SELECT NULL, COUNT(*), COUNT(*) FILTER (WHERE is_winner), SUM(CASE WHEN is_winner THEN bid_amount_mkd END), 0 FROM j"""),
    "p13_tracked_competitors": (lambda t: p.tracked_competitors(t.tenders), f"""
    SELECT w.winner, awards, value, categories
    FROM (SELECT winner, COUNT(*) AS awards, SUM(actual_value_mkd) AS value FROM tenders WHERE {WON} GROUP BY 1) w
    LEFT JOIN (SELECT winner, '[' || string_agg('{{"category":"' || category || '","n":' || n || '}}', ',' ORDER BY place) || ']' AS categories
               FROM (SELECT winner, category, COUNT(*) AS n, row_number() OVER (PARTITION BY winner ORDER BY COUNT(*) DESC, category) AS place FROM tenders WHERE {WON} AND category IS NOT NULL GROUP BY 1, 2) x
               WHERE place <= 3 GROUP BY 1) c ON c.winner = w.winner"""),
    "p14_overview": (lambda t: p.overview(t.tenders, AS_OF), f"""
    SELECT COUNT(*) AS tenders, COUNT(*) FILTER (WHERE status = 'open') AS open, COUNT(*) FILTER (WHERE status = 'awarded') AS awarded, COUNT(*) FILTER (WHERE closing_date BETWEEN {DAY} AND {DAY} + 7) AS closing_soon,
           COUNT(DISTINCT category) AS categories, COUNT(DISTINCT procuring_entity) AS buyers, SUM(estimated_value_mkd) AS estimated, COUNT(*) FILTER (WHERE publication_date >= {DAY} - 30) AS recent FROM tenders"""),
    "p17_cpv_divisions": (lambda t: p.divisions(t.tenders), """
    SELECT substr(cpv_code, 1, 2) AS division, COUNT(*) AS tenders, COUNT(winner) AS awards, SUM(estimated_value_mkd) AS estimated, COUNT(DISTINCT cpv_code) AS codes, COUNT(DISTINCT category) AS categories
    FROM tenders WHERE cpv_code IS NOT NULL GROUP BY 1"""),
    "p21_country_statistics": (lambda t: p.country_statistics(_countries(t), t.tenders), """
    SELECT n_name AS country, COUNT(tender_id) AS tenders, COUNT(DISTINCT procuring_entity) AS buyers, COUNT(DISTINCT winner) AS winners, SUM(actual_value_mkd) AS value
    FROM nation LEFT JOIN tenders ON split_part(procuring_entity, '|', 1) = n_name GROUP BY 1"""),
    "p22_supplier_details": (lambda t: p.supplier_details(t.tenders, t.bidders), """
    , j AS (SELECT company_name, bid_amount_mkd, category, procuring_entity FROM bidders JOIN tenders USING (tender_id) WHERE is_winner)
    SELECT company_name, 'category' AS kind, category AS value, COUNT(*) AS wins, SUM(bid_amount_mkd) AS amount FROM j WHERE category IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT company_name, 'buyer', procuring_entity, COUNT(*), SUM(bid_amount_mkd) FROM j GROUP BY 1, 3"""),
    "p23_totals": (lambda t: p.totals(t.tenders, t.bidders), f"""
    SELECT *, ROUND(wins * 100.0{D} / tenders, 4) AS win_rate
    FROM (SELECT 'supplier' AS kind, company_name AS name, COUNT(*) AS tenders, COUNT(*) FILTER (WHERE is_winner) AS wins, COALESCE(SUM(CASE WHEN is_winner THEN bid_amount_mkd END), 0) AS value FROM bidders GROUP BY 2
          UNION ALL SELECT 'buyer', procuring_entity, COUNT(*), COUNT(winner), COALESCE(SUM(actual_value_mkd), 0) FROM tenders GROUP BY 2) x"""),
    "p24_buyer_list": (lambda t: p.buyer_list(t.tenders, "machine"), """
    SELECT procuring_entity, COUNT(*) AS tenders, COUNT(*) FILTER (WHERE status = 'open') AS open, SUM(estimated_value_mkd) AS estimated, ROUND(AVG(num_bidders), 4) AS mean_bidders, MAX(publication_date) AS last
    FROM tenders WHERE lower(procuring_entity) LIKE '%machine%' GROUP BY 1 ORDER BY tenders DESC, procuring_entity LIMIT 20"""),
    "p26_product_names": (lambda t: p.product_names(t.items, "a"), """
    SELECT name, COUNT(*) AS lines, SUM(quantity) AS quantity, ROUND(AVG(unit_price), 4) AS mean_price, MIN(unit_price) AS low, MAX(unit_price) AS high, COUNT(DISTINCT company_name) AS sellers
    FROM items WHERE lower(name) LIKE '%a%' GROUP BY 1 ORDER BY lines DESC, name LIMIT 25"""),
    "p28_recent_awards": (lambda t: p.recent_awards(t.tenders, AS_OF, 365, 1e6), f"""
    SELECT tender_id, winner, contract_signing_date, actual_value_mkd, ROUND((actual_value_mkd - estimated_value_mkd) * 100.0{D} / NULLIF(estimated_value_mkd, 0), 4) AS from_estimate
    FROM tenders WHERE {WON} AND contract_signing_date BETWEEN {DAY} - 365 AND {DAY} AND actual_value_mkd >= 1e6"""),
    "p30_offers_against_market": (lambda t: p.offers_against_market(t.items), """
    SELECT company_name, i.name, COUNT(*) AS own, MIN(offers) AS offers, MIN(low) AS low, MAX(high) AS high, ROUND(AVG((unit_price - mean) * 100 / mean), 4) AS off
    FROM items i JOIN (SELECT name, MIN(unit_price) AS low, AVG(unit_price) AS mean, MAX(unit_price) AS high, COUNT(*) AS offers FROM items GROUP BY 1) m ON m.name = i.name GROUP BY 1, 2"""),
    "p31_price_hints": (lambda t: p.price_hints(t.items, ["gear", "plate", "bolt"]), """
    SELECT * FROM (SELECT term, brand, COUNT(*) AS offers, ROUND(AVG(unit_price), 4) AS mean_price, MIN(unit_price) AS low, CAST(row_number() OVER (PARTITION BY term ORDER BY COUNT(*) DESC, brand) AS INTEGER) AS place
                   FROM items JOIN (VALUES ('gear'), ('plate'), ('bolt')) v(term) ON contains(lower(name), term) GROUP BY 1, 2) x WHERE place <= 3"""),
    "p32_status_overview": (lambda t: p.status_overview(t.tenders), """
    SELECT status, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated, ROUND(AVG(num_bidders), 4) AS mean_bidders, COUNT(DISTINCT procuring_entity) AS buyers, MAX(publication_date) AS last FROM tenders GROUP BY 1"""),
    "p33_buyer_ranking": (lambda t: p.buyer_ranking(t.tenders), f"""
    SELECT procuring_entity, awards, mean_offers, saved_percent, leader
    FROM (SELECT procuring_entity, COUNT(*) AS awards, ROUND(AVG(num_bidders), 4) AS mean_offers, ROUND(SUM(estimated_value_mkd - actual_value_mkd) * 100.0{D} / SUM(estimated_value_mkd), 4) AS saved_percent
          FROM tenders WHERE {WON} GROUP BY 1 ORDER BY awards DESC, procuring_entity LIMIT 30) r
    JOIN (SELECT procuring_entity AS pe, winner AS leader FROM (SELECT procuring_entity, winner, row_number() OVER (PARTITION BY procuring_entity ORDER BY COUNT(*) DESC, winner) AS place FROM tenders WHERE {WON} GROUP BY 1, 2) x
          WHERE place = 1) l ON pe = procuring_entity"""),
    "p36_supplier_statistics": (lambda t: p.supplier_statistics(t.bidders, t.tenders, AS_OF), f"""
    SELECT company_name, COUNT(*) AS offers, COUNT(*) FILTER (WHERE is_winner) AS wins, MIN(bid_amount_mkd) AS low, MAX(bid_amount_mkd) AS high, COUNT(DISTINCT date_trunc('month', publication_date)) AS months,
           ROUND(COUNT(*) FILTER (WHERE is_winner AND publication_date >= {DAY} - 182) * 100.0{D} / NULLIF(COUNT(*) FILTER (WHERE publication_date >= {DAY} - 182), 0), 4) AS half_year,
           ROUND(COUNT(*) FILTER (WHERE is_winner AND publication_date >= {DAY} - 365) * 100.0{D} / NULLIF(COUNT(*) FILTER (WHERE publication_date >= {DAY} - 365), 0), 4) AS year
    FROM bidders JOIN tenders USING (tender_id) GROUP BY 1"""),
    "p44_scored_leads": (_leads, """
    , c AS (SELECT company_name, COUNT(*) AS bids, COUNT(*) FILTER (WHERE is_winner) AS wins FROM bidders GROUP BY 1),
    u AS (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS views, COUNT(*) FILTER (WHERE event_type = 'click') AS clicks, bool_or(event_type = 'signup' AND event_id % 40 = 0) AS signed FROM events GROUP BY 1)
    SELECT company_name, user_id, score
    FROM (SELECT company_name, user_id, CAST(FLOOR(LEAST(bids / 10, 30) + LEAST(wins * 2, 30) + LEAST(views + 2 * clicks, 40)) AS INTEGER) AS score FROM u JOIN c ON company_name = 'CO-' || (user_id % 7) WHERE NOT signed) x
    WHERE score >= 12"""),
    "p48_sector_insights": (lambda t: p.sector_insights(t.tenders, _interests(t), AS_OF), f"""
    SELECT *, recent > earlier AS trending
    FROM (SELECT 'fan of ' || category AS user_id, category AS sector, COUNT(*) FILTER (WHERE status = 'open') AS open, ROUND(AVG(CASE WHEN status = 'open' THEN estimated_value_mkd END), 4) AS mean_budget,
                 COUNT(*) FILTER (WHERE status = 'open' AND closing_date BETWEEN {DAY} AND {DAY} + 14) AS closing_soon, COUNT(*) FILTER (WHERE publication_date >= {DAY} - 90) AS recent,
                 COUNT(*) FILTER (WHERE publication_date BETWEEN {DAY} - 180 AND {DAY} - 91) AS earlier FROM tenders WHERE category IS NOT NULL GROUP BY category) x"""),
    "p49_related_companies": (lambda t: p.related_companies(t.tenders, t.bidders, AS_OF, 40), f"""
    , w AS (SELECT DISTINCT category, winner, publication_date FROM tenders WHERE {WON} AND category IS NOT NULL)
    SELECT DISTINCT category, winner AS company_name FROM w WHERE category IN (SELECT category FROM w WHERE publication_date >= {DAY} - 40)
      AND (category, winner) NOT IN (SELECT (category, winner) FROM w WHERE publication_date >= {DAY} - 40)"""),
    "p55_best_contacts": (_contacts, """
    SELECT company_id, email, confidence
    FROM (SELECT s_suppkey AS company_id, 'm' || n || '-' || s_suppkey AS email, s_suppkey * n % 7 AS confidence, row_number() OVER (PARTITION BY s_suppkey ORDER BY s_suppkey * n % 7 DESC, n = 2, 'm' || n || '-' || s_suppkey) AS place
          FROM supplier, (VALUES (1), (2), (3)) v(n) WHERE n < 3 OR s_suppkey % 4 <> 0) x WHERE place = 1"""),
    "p59_co_bidders": (lambda t: p.co_bidders(t.bidders), """
    SELECT a.company_name, b.company_name AS other, COUNT(*) AS together FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name GROUP BY 1, 2 HAVING COUNT(*) >= 5"""),
    "p60_sector_bidding": (lambda t: p.sector_bidding(t.tenders, t.bidders), f"""
    SELECT s.category, tenders, bids_each, value_ratio_pct, leaders
    FROM (SELECT category, COUNT(*) AS tenders, ROUND(AVG(num_bidders), 4) AS bids_each, ROUND(SUM(actual_value_mkd) * 100.0{D} / SUM(CASE WHEN actual_value_mkd IS NOT NULL THEN estimated_value_mkd END), 4) AS value_ratio_pct
          FROM tenders WHERE category IS NOT NULL GROUP BY 1) s
    LEFT JOIN (SELECT category, string_agg(winner, ',' ORDER BY place) AS leaders
               FROM (SELECT category, winner, row_number() OVER (PARTITION BY category ORDER BY COUNT(*) DESC, winner) AS place FROM tenders WHERE {WON} GROUP BY 1, 2) x WHERE place <= 5 GROUP BY 1) l ON l.category = s.category"""),
    "p65_grouped_statistics": (lambda t: p.grouped_statistics(t.tenders), "".join(f"""
    {"UNION ALL " if n else ""}SELECT '{grain}' AS grain, {key} AS key, COUNT(*) AS tenders, COUNT(actual_value_mkd) AS awards, SUM(actual_value_mkd) AS value FROM tenders WHERE {key} IS NOT NULL GROUP BY 2"""
        for n, (grain, key) in enumerate((("buyer", "procuring_entity"), ("winner", "winner"), ("year", "CAST(year(publication_date) AS VARCHAR)"), ("division", "substr(cpv_code, 1, 2)"), ("status", "status"), ("month", "strftime(publication_date, '%Y-%m')"), ("all", "'all'"))))),
    "p66_risk_lists": ((lambda t: (lambda own, flags: p.risk_lists(flags, own.tenders))(*flag_tables(t))), None),
    "p68_company_wins": (lambda t: p.company_wins(t.tenders), f"""
    SELECT t.winner, wins, value, first, last, sectors, recent
    FROM (SELECT winner, COUNT(*) AS wins, SUM(actual_value_mkd) AS value, MIN(publication_date) AS first, MAX(publication_date) AS last FROM tenders WHERE {WON} GROUP BY 1) t
    LEFT JOIN ({_listed("sectors", "category", f"SELECT winner, category, row_number() OVER (PARTITION BY winner ORDER BY COUNT(*) DESC, category) AS place FROM tenders WHERE {WON} AND category IS NOT NULL GROUP BY 1, 2")}) s ON s.winner = t.winner
    JOIN ({_listed("recent", "tender_id", f"SELECT winner, tender_id, row_number() OVER (PARTITION BY winner ORDER BY publication_date DESC, tender_id) AS place FROM tenders WHERE {WON}")}) r ON r.winner = t.winner"""),
    "p69_sector_overview": (lambda t: p.sector_overview(t.tenders, AS_OF), """
    SELECT category, COUNT(*) AS tenders, COUNT(actual_value_mkd) AS awards, SUM(actual_value_mkd) AS value, MIN(actual_value_mkd) AS low, ROUND(AVG(actual_value_mkd), 4) AS mean, ROUND(quantile_cont(actual_value_mkd, 0.5), 4) AS median,
           MAX(actual_value_mkd) AS high, COUNT(DISTINCT winner) AS winners, COUNT(DISTINCT procuring_entity) AS buyers, COUNT(*) FILTER (WHERE publication_date >= DATE '2000-08-01') AS last_year
    FROM tenders WHERE category IS NOT NULL GROUP BY 1"""),
    "p73_company_bid_patterns": (lambda t: p.company_bid_patterns(t.bidders, t.tenders), """
    SELECT b.company_name, ROUND(AVG(bid_amount_mkd * 100 / NULLIF(estimated_value_mkd, 0)), 4) AS of_estimate, ROUND(stddev_samp(bid_amount_mkd * 100 / NULLIF(estimated_value_mkd, 0)), 4) AS spread,
           COUNT(*) FILTER (WHERE is_winner AND num_bidders = 1) AS single_wins, COUNT(*) FILTER (WHERE is_winner AND closing_date - publication_date < 7) AS short_wins, COUNT(DISTINCT cpv_code) AS codes, ANY_VALUE(COALESCE(co, 0)) AS co_bidders
    FROM bidders b JOIN tenders USING (tender_id)
    LEFT JOIN (SELECT company_name, COUNT(*) AS co FROM (SELECT a.company_name, z.company_name AS other FROM bidders a JOIN bidders z ON a.tender_id = z.tender_id AND a.company_name <> z.company_name GROUP BY 1, 2 HAVING COUNT(*) >= 3) m
               GROUP BY 1) c ON c.company_name = b.company_name GROUP BY 1"""),
    "p75_bidder_distribution": (lambda t: p.bidder_distribution(t.tenders), f"""
    SELECT procuring_entity, num_bidders, COUNT(*) AS tenders, ROUND(COUNT(*) * 100.0{D} / SUM(COUNT(*)) OVER (PARTITION BY procuring_entity), 4) AS share, ANY_VALUE(md) AS median
    FROM tenders JOIN (SELECT procuring_entity, quantile_cont(num_bidders, 0.5) AS md FROM tenders WHERE num_bidders IS NOT NULL GROUP BY 1) m USING (procuring_entity) WHERE num_bidders IS NOT NULL GROUP BY 1, 2"""),
    "p76_buyer_patterns": (lambda t: p.buyer_patterns(t.tenders), f"""
    SELECT procuring_entity, COUNT(*) AS tenders, ROUND(AVG(estimated_value_mkd), 4) AS mean, ROUND(stddev_samp(estimated_value_mkd), 4) AS spread, ROUND(COUNT(*) FILTER (WHERE closing_date - publication_date < 7) * 100.0{D} / COUNT(*), 4) AS short_share,
           COUNT(DISTINCT category) AS categories, ROUND(ANY_VALUE(lead) * 100.0{D} / COUNT(*), 4) AS leading_share
    FROM tenders JOIN (SELECT procuring_entity, MAX(n) AS lead FROM (SELECT procuring_entity, category, COUNT(*) AS n FROM tenders WHERE category IS NOT NULL GROUP BY 1, 2) x GROUP BY 1) l USING (procuring_entity) GROUP BY 1"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + sql for name, (_, sql) in _ALL.items() if sql}
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
ORACLES["p66_risk_lists"] = FLAGS_SQL + " UNION ALL ".join(
    f"SELECT '{grain}' AS grain, {key} AS name, COUNT(*) AS flags, SUM(score) AS total_score, MAX({RANK}) AS worst FROM flags f JOIN tenders t ON f.tender_id = t.tender_id WHERE {key} IS NOT NULL GROUP BY 2"
    for grain, key in (("tender", "t.tender_id"), ("buyer", "procuring_entity"), ("company", "winner"))
)
