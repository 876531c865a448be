"""Registered queries of the indicators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.operators import indicators as i
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

AS = "DATE '2001-08-01'"
OWN = "status IN ('awarded', 'completed')"


def _ladder(*steps: tuple[str, float], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {n}::DOUBLE" for c, n in steps) + f" ELSE {other} END"


#: What each indicator's evidence holds, as SQL over its rows.
EVIDENCE = {
    "single_bidder": {"wins": "wins"},
    "low_participation": {"bidders": "num_bidders", "z": "z"},
    "same_bidder_set": {"matches": "m"},
    "bidder_diversity": {"evenness": "share"},
    "new_bidder_rate": {"rate": "rate"},
    "market_concentration": {"hhi": "hhi"},
    "bidder_turnover": {"rate": "rate"},
    "geographic_concentration": {"percent": "pct"},
    "bidder_experience": {"percent": "pct"},
    "competition_trend": {"slope": "s"},
    "price_deviation": {"deviation": "ABS(d)"},
    "bid_clustering": {"cov": "c"},
    "cover_bidding": {"low": "low", "second": "second"},
    "round_number": {"share": "r1 / n"},
    "price_fixing": {"equal": "m"},
    "below_market": {"deviation": "d"},
    "price_variance": {"cov": "c"},
    "winner_z_score": {"z": "z"},
    "estimate_match": {"won": "CAST(w AS INTEGER)"},
    "price_sequence": {"evenness": "rel"},
    "short_deadline": {"days": "d"},
    "weekend_publication": {"weekend": "CAST(w AS INTEGER)"},
    "election_cycle": {"days": "gap"},
    "seasonal_pattern": {"z": "z"},
    "amendment_timing": {"amendments": "n"},
    "last_minute_submission": {"last_hour": "h"},
    "process_duration": {"days": "days", "z": "z"},
    "publication_pattern": {"weekend": "CAST(isodow(publication_date) >= 6 AS INTEGER)"},
    "deadline_extension": {"extensions": "n"},
    "submission_clustering": {"seconds": "g"},
    "repeat_winner": {"wins": "wins", "percent": "p"},
}


def _ind(name: str, category: str, threshold: float, score: str, rows: str) -> str:
    parts = " || ',' || ".join(f"'\"{k}\":' || COALESCE(CAST(TRY_CAST({v} AS DECIMAL(20, 4)) AS VARCHAR), 'null')" for k, v in EVIDENCE[name].items())
    return f"""SELECT tender_id, '{name}' AS indicator, '{category}' AS category, LEAST(100.0::DOUBLE, GREATEST(0.0::DOUBLE, raw)) AS score, {i.WEIGHTS[name]}::DOUBLE AS weight, {threshold}::DOUBLE AS threshold,
       {i.CONFIDENCE.get(name, 1.0)}::DOUBLE AS confidence, raw >= {threshold} AS triggered, evidence
FROM (SELECT tender_id, ROUND(CAST({score} AS DOUBLE), 6) AS raw, '{{' || {parts} || '}}' AS evidence FROM ({rows}) r) s"""


STATS = "(SELECT tender_id, COUNT(*) AS n, AVG(bid_amount_mkd) AS mean, stddev_samp(bid_amount_mkd) AS sd, MAX(CASE WHEN is_winner THEN bid_amount_mkd END) AS wb, list_sort(list(bid_amount_mkd)) AS bids FROM bidders WHERE bid_amount_mkd > 0 GROUP BY tender_id HAVING COUNT(*) >= {})"
BB = "(SELECT DISTINCT procuring_entity, company_name, publication_date AS day FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id)"
DAYS = "(SELECT DISTINCT procuring_entity, publication_date FROM tenders)"

SQL = {
    "single_bidder": _ind("single_bidder", "competition", 60, "60 + CASE WHEN estimated_value_mkd > 5000000 THEN 20 ELSE 0 END + CASE WHEN wins >= 3 THEN 15 ELSE 0 END + CASE WHEN lower(procedure_type) NOT LIKE '%negotiated%' THEN 10 ELSE 0 END",
        f"SELECT t.tender_id, t.estimated_value_mkd, t.procedure_type, (SELECT COUNT(*) FROM tenders p WHERE p.procuring_entity = t.procuring_entity AND p.winner = t.winner AND p.publication_date < t.publication_date AND p.publication_date >= t.publication_date - 365 AND p.{OWN}) AS wins FROM tenders t WHERE num_bidders = 1"),
    "low_participation": _ind("low_participation", "competition", 55, _ladder(("z >= 2", 80), ("z >= 1.5", 65), ("z >= 1", 50), other="GREATEST(0, 30 - num_bidders / mean * 20)"),
        f"SELECT tender_id, num_bidders, mean, CASE WHEN sd > 0 THEN (mean - num_bidders) / sd ELSE 0 END AS z FROM tenders JOIN (SELECT cpv_code, AVG(num_bidders) AS mean, stddev_samp(num_bidders) AS sd FROM tenders WHERE {OWN} AND num_bidders > 0 AND publication_date >= {AS} - 365 GROUP BY cpv_code) c USING (cpv_code) WHERE num_bidders > 0"),
    "same_bidder_set": _ind("same_bidder_set", "competition", 65, _ladder(("m >= 10", 90), ("m >= 7", 80), ("m >= 5", 70), ("m >= 3", 60), other="40"),
        f"SELECT tender_id, SUM(r) OVER (PARTITION BY c) - r AS m FROM (SELECT b.tender_id, string_agg(company_name, '|' ORDER BY company_name) AS c, MAX(CASE WHEN publication_date >= {AS} - 730 THEN 1 ELSE 0 END) AS r FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id GROUP BY b.tender_id) x QUALIFY SUM(r) OVER (PARTITION BY c) - r > 0"),
    "bidder_diversity": _ind("bidder_diversity", "competition", 60, "(1 - share) * 100",
        f"""SELECT tender_id, share FROM tenders JOIN (SELECT procuring_entity, CASE WHEN COUNT(*) > 1 THEN -SUM(n / total * log2(n / total)) / log2(COUNT(*)) ELSE 0 END AS share FROM (
        SELECT procuring_entity, company_name, COUNT(*)::DOUBLE AS n, SUM(COUNT(*)) OVER (PARTITION BY procuring_entity)::DOUBLE AS total FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE publication_date >= {AS} - 365 GROUP BY procuring_entity, company_name) x GROUP BY procuring_entity) y USING (procuring_entity)"""),
    "new_bidder_rate": _ind("new_bidder_rate", "competition", 65, _ladder(("rate < 10", 85), ("rate < 20", 70), ("rate < 30", 50), other="GREATEST(0, 40 - rate)"),
        f"""SELECT tender_id, rate FROM tenders JOIN (SELECT procuring_entity, publication_date, SUM(CASE WHEN first_day >= publication_date - 365 THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*) AS rate FROM (
        SELECT d.procuring_entity, d.publication_date, b.company_name, MIN(f.first_day) AS first_day FROM {DAYS} d JOIN {BB} b ON b.procuring_entity = d.procuring_entity AND b.day < d.publication_date AND b.day >= d.publication_date - 365
        JOIN (SELECT procuring_entity, company_name, MIN(day) AS first_day FROM {BB} z GROUP BY procuring_entity, company_name) f ON f.procuring_entity = b.procuring_entity AND f.company_name = b.company_name
        GROUP BY d.procuring_entity, d.publication_date, b.company_name) x GROUP BY procuring_entity, publication_date) y USING (procuring_entity, publication_date)"""),
    "bidder_turnover": _ind("bidder_turnover", "competition", 65, _ladder(("rate > 90", 80), ("rate > 80", 70), ("rate > 70", 55), other="GREATEST(0, rate - 30)"),
        f"""SELECT tender_id, rate FROM tenders JOIN (SELECT procuring_entity, publication_date, SUM(late) * 100.0::DOUBLE / COUNT(*) AS rate FROM (
        SELECT d.procuring_entity, d.publication_date, b.company_name, MAX(CASE WHEN b.day >= d.publication_date - 182 THEN 1 ELSE 0 END) AS late, MAX(CASE WHEN b.day < d.publication_date - 182 THEN 1 ELSE 0 END) AS early
        FROM {DAYS} d JOIN {BB} b ON b.procuring_entity = d.procuring_entity AND b.day < d.publication_date AND b.day >= d.publication_date - 365 GROUP BY d.procuring_entity, d.publication_date, b.company_name) x WHERE early = 1 GROUP BY procuring_entity, publication_date) y USING (procuring_entity, publication_date)"""),
    "market_concentration": _ind("market_concentration", "competition", 70, _ladder(("hhi > 2500", 90), ("hhi > 1800", 75), ("hhi > 1500", 60), other="hhi / 1500 * 40"),
        f"SELECT tender_id, hhi FROM tenders JOIN (SELECT procuring_entity, SUM(n * n) * 10000.0::DOUBLE / (SUM(n) * SUM(n)) AS hhi FROM (SELECT procuring_entity, winner, COUNT(*) AS n FROM tenders WHERE {OWN} AND winner IS NOT NULL AND publication_date >= {AS} - 730 GROUP BY procuring_entity, winner) x GROUP BY procuring_entity) y USING (procuring_entity)"),
    "geographic_concentration": _ind("geographic_concentration", "competition", 70, _ladder(("pct = 100", 85), ("pct >= 80", 70), ("pct >= 60", 55), other="GREATEST(0, pct - 20)"),
        "SELECT tender_id, MAX(n) * 100.0::DOUBLE / SUM(n) AS pct FROM (SELECT tender_id, company_city, COUNT(*) AS n FROM bidders WHERE company_city IS NOT NULL GROUP BY tender_id, company_city) x GROUP BY tender_id HAVING SUM(n) >= 2"),
    "bidder_experience": _ind("bidder_experience", "competition", 65, _ladder(("pct = 100", 85), ("pct >= 75", 70), ("pct >= 50", 55), other="GREATEST(0, pct - 10)"),
        """SELECT tender_id, SUM(CASE WHEN before < 3 THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*) AS pct FROM (SELECT b.tender_id, COUNT(*) OVER (PARTITION BY company_name ORDER BY publication_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - COUNT(*) OVER (PARTITION BY company_name, publication_date) AS before
        FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id) x GROUP BY tender_id"""),
    "competition_trend": _ind("competition_trend", "competition", 65, _ladder(("s < -0.3", 85), ("s < -0.15", 70), ("s < 0", 55), other="GREATEST(0, 30 - s * 20)"),
        f"""SELECT tender_id, s FROM tenders JOIN (SELECT procuring_entity, ROUND(regr_slope(y, x), 9) AS s FROM (SELECT procuring_entity, y, row_number() OVER (PARTITION BY procuring_entity ORDER BY m) - 1 AS x FROM (
        SELECT procuring_entity, date_trunc('month', publication_date) AS m, AVG(num_bidders) AS y FROM tenders WHERE status IN ('awarded', 'completed', 'active') AND num_bidders IS NOT NULL AND publication_date >= {AS} - 365 GROUP BY procuring_entity, m HAVING COUNT(*) >= 3) a) b GROUP BY procuring_entity HAVING COUNT(*) >= 3) c USING (procuring_entity)"""),
    "price_deviation": _ind("price_deviation", "price", 60, _ladder(("ABS(d) > 30", 90), ("ABS(d) > 20", 75), ("ABS(d) > 10", 60), ("ABS(d) > 5", 45), other="ABS(d) * 5") + " + CASE WHEN d > 0 AND num_bidders = 1 THEN 15 ELSE 0 END",
        "SELECT tender_id, num_bidders, (actual_value_mkd - estimated_value_mkd) / estimated_value_mkd * 100 AS d FROM tenders WHERE estimated_value_mkd > 0 AND actual_value_mkd > 0"),
    "bid_clustering": _ind("bid_clustering", "price", 65, _ladder(("c < 0.01", 95), ("c < 0.02", 85), ("c < 0.05", 70), ("c < 0.10", 50), other="GREATEST(0, (0.20::DOUBLE - c) * 200)"), f"SELECT tender_id, sd / mean AS c FROM {STATS.format(3)} x"),
    "cover_bidding": _ind("cover_bidding", "price", 70, _ladder(("g > 20", 90), ("g > 15", 80), ("g > 10", 70), ("g > 5", 55), other="g * 8"), f"SELECT tender_id, (bids[2] - bids[1]) / bids[1] * 100 AS g, bids[1] AS low, bids[2] AS second FROM {STATS.format(2)} x"),
    "round_number": _ind("round_number", "price", 60, _ladder(("r10 = n", 80), ("r5 = n", 70), ("r1 = n", 60), ("r10 / n > 0.7", 65), ("r1 / n > 0.8", 50), other="r1 / n * 40"),
        "SELECT tender_id, COUNT(*) AS n, SUM(CASE WHEN bid_amount_mkd % 10000 = 0 THEN 1 ELSE 0 END) AS r10, SUM(CASE WHEN bid_amount_mkd % 5000 = 0 THEN 1 ELSE 0 END) AS r5, SUM(CASE WHEN bid_amount_mkd % 1000 = 0 THEN 1 ELSE 0 END) AS r1 FROM bidders WHERE bid_amount_mkd > 0 GROUP BY tender_id"),
    "price_fixing": _ind("price_fixing", "price", 80, "CASE WHEN m >= 3 THEN 95 ELSE 75 END", "SELECT tender_id, MAX(n) AS m FROM (SELECT tender_id, bid_amount_mkd, COUNT(*) AS n FROM bidders WHERE bid_amount_mkd > 0 GROUP BY tender_id, bid_amount_mkd) x GROUP BY tender_id HAVING MAX(n) > 1"),
    "below_market": _ind("below_market", "price", 65, _ladder(("d < -50", 90), ("d < -30", 75), ("d < -20", 60), ("z > 2", 65), other="CASE WHEN d < 0 THEN GREATEST(0, ABS(d) - 10) ELSE 0 END"),
        f"""SELECT tender_id, (v - mean) / mean * 100 AS d, CASE WHEN sd > 0 THEN (mean - v) / sd ELSE 0 END AS z FROM (SELECT t.tender_id, t.actual_value_mkd AS v, AVG(o.actual_value_mkd) AS mean, stddev_samp(o.actual_value_mkd) AS sd FROM tenders t
        JOIN tenders o ON o.cpv_code = t.cpv_code AND o.tender_id <> t.tender_id WHERE t.actual_value_mkd > 0 AND o.{OWN} AND o.actual_value_mkd > 0 AND o.publication_date >= {AS} - 365 GROUP BY t.tender_id, t.actual_value_mkd HAVING COUNT(*) >= 5) x"""),
    "price_variance": _ind("price_variance", "price", 60, _ladder(("c < 0.02", 85), ("c < 0.05", 65), ("c > 0.30", 70), ("c > 0.20", 50), other="0"), f"SELECT tender_id, sd / mean AS c FROM {STATS.format(3)} x"),
    "winner_z_score": _ind("winner_z_score", "price", 65, _ladder(("z > 3", 90), ("z > 2", 75), ("z > 1.5", 60), other="z * 30"), f"SELECT tender_id, ABS(CASE WHEN sd > 0 THEN (wb - mean) / sd ELSE 0 END) AS z FROM {STATS.format(3)} x WHERE wb IS NOT NULL"),
    "estimate_match": _ind("estimate_match", "price", 75, "85 + CASE WHEN w THEN 10 ELSE 0 END", "SELECT b.tender_id, bool_or(is_winner) AS w FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id WHERE estimated_value_mkd > 0 AND bid_amount_mkd > 0 AND ABS(bid_amount_mkd - estimated_value_mkd) / estimated_value_mkd < 0.01 GROUP BY b.tender_id"),
    "price_sequence": _ind("price_sequence", "price", 70, _ladder(("rel < 0.01", 85), ("rel < 0.05", 70), other="0"),
        "SELECT tender_id, CASE WHEN AVG(g) > 0 THEN var_samp(g) / (AVG(g) * AVG(g)) ELSE 0 END AS rel FROM (SELECT tender_id, bid_amount_mkd - lag(bid_amount_mkd) OVER (PARTITION BY tender_id ORDER BY bid_amount_mkd) AS g FROM bidders WHERE bid_amount_mkd > 0) x GROUP BY tender_id HAVING COUNT(*) >= 3"),
    "short_deadline": _ind("short_deadline", "timing", 60, _ladder(("d < 3", 95), ("d < 5", 85), ("d < 7", 70), ("d < 10", 55), ("d < 14", 40), other="GREATEST(0, 30 - d)") + " + CASE WHEN num_bidders = 1 THEN 15 ELSE 0 END + CASE WHEN estimated_value_mkd > 5000000 THEN 10 ELSE 0 END",
        "SELECT *, closing_date - publication_date AS d FROM tenders"),
    "weekend_publication": _ind("weekend_publication", "timing", 65, "CASE WHEN w THEN 70 ELSE 0 END + CASE WHEN w AND num_bidders BETWEEN 1 AND 2 THEN 15 ELSE 0 END", "SELECT tender_id, num_bidders, date_part('dow', publication_date) IN (0, 6) AS w FROM tenders"),
    "election_cycle": _ind("election_cycle", "timing", 65, _ladder(("ahead AND gap < 30", 80), ("ahead AND gap < 60", 70), ("ahead AND gap < 90", 60), ("gap < 180", 40), other="0"),
        """SELECT tender_id, MIN(ABS(e - publication_date)) AS gap, arg_min(publication_date < e, (ABS(e - publication_date), e)) AS ahead FROM tenders, (VALUES (DATE '1994-10-16'), (DATE '1998-10-18'), (DATE '2002-09-15')) v(e) GROUP BY tender_id"""),
    "seasonal_pattern": _ind("seasonal_pattern", "timing", 60, _ladder(("m = 12 AND z > 2", 75), ("m = 12 AND z > 1", 60), ("z > 2.5", 70), ("z > 2", 55), other="0"),
        """SELECT tender_id, m, ROUND(CASE WHEN sd > 0 THEN (n - mean) / sd ELSE 0 END, 9) AS z FROM (SELECT tender_id, procuring_entity, year(publication_date) AS y, month(publication_date) AS m FROM tenders) t JOIN (
        SELECT procuring_entity, y, m, n, AVG(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM (SELECT procuring_entity, year(publication_date) AS y, month(publication_date) AS m, COUNT(*) AS n FROM tenders GROUP BY 1, 2, 3) x WINDOW w AS (PARTITION BY procuring_entity, y)) s USING (procuring_entity, y, m)"""),
    "amendment_timing": _ind("amendment_timing", "timing", 65, _ladder(("a > 0", 80), ("b > 0", 65), ("n > 3", 50), other="0"),
        "SELECT tender_id, COUNT(*) AS n, SUM(CASE WHEN closing_date - amendment_date < 3 THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN closing_date - amendment_date < 7 THEN 1 ELSE 0 END) AS b FROM amendments GROUP BY tender_id"),
    "last_minute_submission": _ind("last_minute_submission", "timing", 60, _ladder(("h = n AND n >= 2", 85), ("d = n AND n >= 3", 70), ("h / n > 0.75", 65), other="0"),
        "SELECT tender_id, COUNT(*) AS n, SUM(CASE WHEN minutes_before_close < 60 THEN 1 ELSE 0 END) AS h, SUM(CASE WHEN minutes_before_close < 1440 THEN 1 ELSE 0 END) AS d FROM bidders WHERE minutes_before_close IS NOT NULL GROUP BY tender_id"),
    "process_duration": _ind("process_duration", "timing", 60, _ladder(("z > 2 AND days < 14", 80), ("z > 1.5", 65), ("days < 7", 70), other="0"),
        f"SELECT tender_id, days, CASE WHEN sd > 0 THEN (FLOOR(mean) - days) / sd ELSE 0 END AS z FROM (SELECT *, contract_signing_date - publication_date AS days FROM tenders) t JOIN (SELECT procedure_type, AVG(contract_signing_date - publication_date) AS mean, stddev_samp(contract_signing_date - publication_date) AS sd FROM tenders WHERE publication_date >= {AS} - 365 GROUP BY procedure_type) s USING (procedure_type)"),
    "publication_pattern": _ind("publication_pattern", "timing", 65, "CASE WHEN date_part('dow', publication_date) IN (0, 6) THEN 60 ELSE 0 END", "SELECT * FROM tenders"),
    "deadline_extension": _ind("deadline_extension", "timing", 60, _ladder(("n >= 3", 80), ("n = 2", 65), other="50"), "SELECT tender_id, COUNT(*) AS n FROM amendments WHERE field_changed = 'closing_date' GROUP BY tender_id"),
    "submission_clustering": _ind("submission_clustering", "timing", 70, _ladder(("g < 300", 90), ("g < 900", 80), ("g < 3600", 70), other="0"),
        "SELECT tender_id, MAX(gap) * 60 AS g FROM (SELECT tender_id, minutes_before_close - lag(minutes_before_close) OVER (PARTITION BY tender_id ORDER BY minutes_before_close, company_name) AS gap FROM bidders WHERE minutes_before_close IS NOT NULL) x GROUP BY tender_id HAVING COUNT(*) >= 3"),
    "repeat_winner": _ind("repeat_winner", "relationship", 65, _ladder(("p > 80", 95), ("p > 70", 85), ("p > 60", 75), ("p > 50", 60), other="GREATEST(0, p - 20)") + " + CASE WHEN wins > 10 THEN 10 ELSE 0 END",
        f"SELECT tender_id, wins, wins * 100.0::DOUBLE / total AS p FROM tenders JOIN (SELECT procuring_entity, winner, COUNT(*) AS wins, SUM(COUNT(*)) OVER (PARTITION BY procuring_entity) AS total FROM tenders WHERE {OWN} AND winner IS NOT NULL AND publication_date >= {AS} - 730 GROUP BY procuring_entity, winner) s USING (procuring_entity, winner) WHERE total >= 5"),
}

_RUN = {
    "single_bidder": lambda t: i.single_bidder(t.tenders),
    "low_participation": lambda t: i.low_participation(t.tenders, AS_OF),
    "same_bidder_set": lambda t: i.same_bidder_set(t.tenders, t.bidders, AS_OF),
    "bidder_diversity": lambda t: i.bidder_diversity(t.tenders, t.bidders, AS_OF),
    "new_bidder_rate": lambda t: i.new_bidder_rate(t.tenders, t.bidders, parts=t.parts),
    "market_concentration": lambda t: i.market_concentration(t.tenders, AS_OF),
    "bidder_turnover": lambda t: i.bidder_turnover(t.tenders, t.bidders, parts=t.parts),
    "geographic_concentration": lambda t: i.geographic_concentration(t.bidders),
    "bidder_experience": lambda t: i.bidder_experience(t.tenders, t.bidders),
    "competition_trend": lambda t: i.competition_trend(t.tenders, AS_OF),
    "price_deviation": lambda t: i.price_deviation(t.tenders),
    "bid_clustering": lambda t: i.bid_clustering(t.bidders),
    "cover_bidding": lambda t: i.cover_bidding(t.bidders),
    "round_number": lambda t: i.round_number(t.bidders),
    "price_fixing": lambda t: i.price_fixing(t.bidders),
    "below_market": lambda t: i.below_market(t.tenders, AS_OF),
    "price_variance": lambda t: i.price_variance(t.bidders),
    "winner_z_score": lambda t: i.winner_z_score(t.bidders),
    "estimate_match": lambda t: i.estimate_match(t.tenders, t.bidders),
    "price_sequence": lambda t: i.price_sequence(t.bidders),
    "short_deadline": lambda t: i.short_deadline(t.tenders),
    "weekend_publication": lambda t: i.weekend_publication(t.tenders),
    "election_cycle": lambda t: i.election_cycle(t.tenders),
    "seasonal_pattern": lambda t: i.seasonal_pattern(t.tenders),
    "amendment_timing": lambda t: i.amendment_timing(t.amendments),
    "last_minute_submission": lambda t: i.last_minute_submission(t.bidders),
    "process_duration": lambda t: i.process_duration(t.tenders, AS_OF),
    "publication_pattern": lambda t: i.publication_pattern(t.tenders),
    "deadline_extension": lambda t: i.deadline_extension(t.amendments),
    "submission_clustering": lambda t: i.submission_clustering(t.bidders),
    "repeat_winner": lambda t: i.repeat_winner(t.tenders, AS_OF),
}


def i32_registry(t):
    """Triggered indicators counted by category."""
    own = t.written()
    found = i.all_indicators(own.tenders, own.bidders, own.amendments, AS_OF, parts=own.parts)
    return found.filter("triggered").groupBy("category", "indicator").agg(F.count(F.lit(1)).alias("tenders"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f"i{n}_{name}": run for n, (name, run) in enumerate(_RUN.items(), 1)} | {"i32_registry": i32_registry}
ORACLES = {f"i{n}_{name}": DOMAIN_SQL + SQL[name] for n, name in enumerate(_RUN, 1)}
ORACLES["i32_registry"] = DOMAIN_SQL + "SELECT category, indicator, COUNT(*) AS tenders, ROUND(AVG(score), 6) AS mean_score FROM (" + "\nUNION ALL\n".join(f"SELECT * FROM ({q}) q{n}" for n, q in enumerate(SQL.values())) + ") u WHERE triggered GROUP BY category, indicator"
