"""Registered queries of company reports, each with its SQL."""

from __future__ import annotations

from bidscope.operators import company_reports as c
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

YEAR = "publication_date >= DATE '2001-08-01' - 365"

#: Bids with their tender, and of each company the five codes of most bids.
_BASE = """
, pb AS (
  SELECT b.tender_id, company_name, is_winner, cpv_code AS code, procuring_entity, publication_date,
         CASE WHEN is_winner THEN COALESCE(actual_value_mkd, 0) ELSE 0 END AS won_value
  FROM bidders b JOIN tenders t ON b.tender_id = t.tender_id),
pc AS (
  SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY bids DESC, won_value DESC, code) AS place
  FROM (SELECT company_name, code, COUNT(*) AS bids, CAST(SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS BIGINT) AS wins, SUM(won_value) AS won_value
        FROM pb WHERE code IS NOT NULL GROUP BY 1, 2) x),
own AS (SELECT company_name, code FROM pc WHERE place <= 5)
"""

_ALL = {
    "p41_report_year": (lambda t: c.report_year(t.tenders, t.bidders, AS_OF), f"""
SELECT company_name, COUNT(*) AS participations, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins,
       ROUND(SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*), 1) AS win_rate, SUM(won_value) AS won_value
FROM pb WHERE {YEAR} GROUP BY 1"""),
    "p41_report_codes": (lambda t: c.report_codes(t.tenders, t.bidders), "SELECT company_name, code, bids, wins, won_value, place FROM pc WHERE place <= 3"),
    "p41_report_buyers": (lambda t: c.report_buyers(t.tenders, t.bidders), """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY bids DESC, won_value DESC, procuring_entity) AS place
  FROM (SELECT company_name, procuring_entity, COUNT(*) AS bids, SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) AS wins, SUM(won_value) AS won_value
        FROM pb WHERE procuring_entity IS NOT NULL GROUP BY 1, 2) x) y WHERE place <= 3"""),
    "p41_report_rivals": (lambda t: c.report_rivals(t.tenders, t.bidders, AS_OF), f"""
, w AS (SELECT code, company_name AS rival, COUNT(*) AS n, SUM(won_value) AS v FROM pb WHERE is_winner AND {YEAR} AND code IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY wins DESC, won_value DESC, rival) AS place
  FROM (SELECT company_name, rival, CAST(SUM(n) AS BIGINT) AS wins, SUM(v) AS won_value FROM own JOIN w USING (code) WHERE rival <> company_name GROUP BY 1, 2 HAVING SUM(n) >= 2) x) y
WHERE place <= 5"""),
    "p41_report_missed": (lambda t: c.report_missed(t.tenders, t.bidders, AS_OF), """
SELECT * FROM (
  SELECT company_name, t.tender_id, code, closing_date, COALESCE(NULLIF(actual_value_mkd, 0), estimated_value_mkd, 0) AS value,
         row_number() OVER (PARTITION BY company_name ORDER BY closing_date DESC, t.tender_id) AS place
  FROM own o JOIN tenders t ON t.cpv_code = o.code
  WHERE publication_date >= DATE '2001-08-01' - 90 AND status IN ('awarded', 'closed')
    AND NOT EXISTS (SELECT 1 FROM bidders b WHERE b.tender_id = t.tender_id AND b.company_name = o.company_name)) x
WHERE place <= 10"""),
    "p41_report_expected": (lambda t: c.report_expected(t.tenders, t.bidders, AS_OF), f"""
SELECT company_name, CAST(FLOOR(COALESCE(n / m, 0) * 0.5) AS BIGINT) AS low, CAST(FLOOR(COALESCE(n / m, 0)) AS BIGINT) AS mid, CAST(FLOOR(COALESCE(n / m, 0) * 1.5) AS BIGINT) AS high,
       CASE WHEN m >= 6 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT company_name, COUNT(tender_id) AS n, NULLIF(COUNT(DISTINCT date_trunc('month', publication_date)), 0) AS m
      FROM own LEFT JOIN (SELECT * FROM tenders WHERE {YEAR} AND publication_date <= DATE '2001-08-01') t ON t.cpv_code = own.code GROUP BY 1) x"""),
    "p41_report_buyer_map": (lambda t: c.report_buyer_map(t.tenders, t.bidders, AS_OF), f"""
, bs AS (
  SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY tenders DESC, value DESC, procuring_entity) AS place
  FROM (SELECT company_name, procuring_entity, COUNT(*) AS tenders, SUM(COALESCE(actual_value_mkd, 0)) AS value
        FROM own JOIN tenders t ON t.cpv_code = own.code WHERE {YEAR} AND procuring_entity IS NOT NULL GROUP BY 1, 2) x),
wb AS (SELECT code, procuring_entity, company_name AS winner, COUNT(*) AS n, SUM(won_value) AS v FROM pb WHERE is_winner AND {YEAR} GROUP BY 1, 2, 3),
ws AS (
  SELECT company_name, procuring_entity, winner, row_number() OVER (PARTITION BY company_name, procuring_entity ORDER BY SUM(n) DESC, SUM(v) DESC, winner) AS p
  FROM own JOIN wb USING (code) GROUP BY 1, 2, 3)
SELECT bs.company_name, bs.procuring_entity, tenders, value, winner AS top_winner, place
FROM bs LEFT JOIN ws ON ws.company_name = bs.company_name AND ws.procuring_entity = bs.procuring_entity AND p = 1 WHERE place <= 10"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + _BASE + sql for name, (_, sql) in _ALL.items()}
