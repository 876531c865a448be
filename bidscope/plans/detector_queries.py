"""Registered queries of the detectors and of the risk index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidscope.operators import detectors as d
from bidscope.sources.domain import DOMAIN_SQL, Tables
from bidscope.workspace import materialize

FLAG = ["tender_id", "flag_type", "severity", "score"]


def _flags(df: DataFrame) -> DataFrame:
    return df.select(*FLAG)


def _sql(name: str, score: str, severity: str, rows: str) -> str:
    """``rows`` is a query with the columns that score and severity (over ``score``) use."""
    return f"SELECT tender_id, '{name}' AS flag_type, {severity} AS severity, CAST(score AS INTEGER) AS score FROM (SELECT *, {score} AS score FROM ({rows}) r) s"


def _case(*steps: tuple[int, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN score >= {n} THEN '{s}'" for n, s in steps) + f" ELSE '{other}' END"


WON = "status IN ('awarded', 'completed') AND winner IS NOT NULL AND winner <> ''"

D1 = _sql("single_bidder", "LEAST(100, 40 + CASE WHEN estimated_value_mkd > 5000000 THEN 20 ELSE 0 END + CASE WHEN prev >= 3 THEN 20 ELSE 0 END)", _case((70, "critical"), (60, "high"), (45, "medium"), other="low"),
    f"SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY procuring_entity, winner ORDER BY publication_date, tender_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tenders WHERE {WON}) x WHERE num_bidders = 1 AND estimated_value_mkd > 500000")


def _d2(share: float, wins: int) -> str:
    return _sql("repeat_winner", "LEAST(100, 50 + CAST(FLOOR((share - 60) / 10) AS INTEGER) * 10 + CASE WHEN wins > 10 THEN 20 ELSE 0 END)", _case((80, "critical"), (70, "high"), (60, "medium"), other="low"),
        f"SELECT *, wins * 100.0::DOUBLE / awards AS share FROM (SELECT procuring_entity, winner, COUNT(*) AS wins, arg_max(tender_id, (publication_date, tender_id)) AS tender_id, SUM(COUNT(*)) OVER (PARTITION BY procuring_entity) AS awards FROM tenders WHERE {WON} GROUP BY procuring_entity, winner) x WHERE wins >= {wins} AND wins * 100.0::DOUBLE / awards > {share}")


def _d3(cov: float) -> str:
    return _sql("price_anomaly", "LEAST(100, 45 + CASE WHEN c THEN 25 ELSE 0 END + CASE WHEN l THEN 20 ELSE 0 END + CASE WHEN e THEN 15 ELSE 0 END)", _case((80, "critical"), (65, "high"), (50, "medium"), other="low"),
        f"""SELECT * FROM (SELECT b.tender_id, sd / NULLIF(av, 0) > 0 AND sd / NULLIF(av, 0) < {cov} AS c, (av - wb) / NULLIF(sd, 0) > 2 AS l, ABS(wb - estimated_value_mkd) / estimated_value_mkd < 0.01 AS e
        FROM (SELECT tender_id, COUNT(*) AS n, AVG(bid_amount_mkd) AS av, stddev_samp(bid_amount_mkd) AS sd, MAX(CASE WHEN is_winner THEN bid_amount_mkd END) AS wb FROM bidders WHERE bid_amount_mkd > 0 GROUP BY tender_id) b
        JOIN tenders t ON b.tender_id = t.tender_id WHERE n >= 3 AND estimated_value_mkd > 0) x WHERE c OR l OR e""")  # fmt: skip


def _pairs(together: int, overlap: float) -> str:
    return f"""(SELECT a.company_name AS company_a, b.company_name AS company_b, COUNT(*) AS together, SUM(CASE WHEN a.is_winner THEN 1 ELSE 0 END) AS aw, SUM(CASE WHEN b.is_winner THEN 1 ELSE 0 END) AS bw, MIN(ta.n) AS an, MIN(tb.n) AS bn
      FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name
      JOIN (SELECT company_name, COUNT(DISTINCT tender_id) AS n FROM bidders GROUP BY company_name) ta ON ta.company_name = a.company_name
      JOIN (SELECT company_name, COUNT(DISTINCT tender_id) AS n FROM bidders GROUP BY company_name) tb ON tb.company_name = b.company_name
      GROUP BY a.company_name, b.company_name HAVING COUNT(*) >= {together} AND COUNT(*) * 100.0 / LEAST(MIN(ta.n), MIN(tb.n)) > {overlap})"""


def _d4(overlap: float) -> str:
    return _sql("bid_clustering", "LEAST(100, 60 + CASE WHEN dom > 80 THEN 20 ELSE 0 END)", _case((75, "critical"), (65, "high"), other="medium"),
        f"""SELECT p.company_a, p.company_b, GREATEST(aw, bw) * 100.0 / together AS dom, arg_max(t.tender_id, (publication_date, t.tender_id)) AS tender_id FROM {_pairs(5, overlap)} p
        JOIN bidders x ON x.company_name = p.company_a JOIN bidders y ON y.company_name = p.company_b AND x.tender_id = y.tender_id JOIN tenders t ON t.tender_id = x.tender_id GROUP BY p.company_a, p.company_b, aw, bw, together""")  # fmt: skip


D5 = _sql("short_deadline", "LEAST(100, 35 + CASE WHEN days < 6 THEN 25 ELSE 0 END + CASE WHEN days < 3 THEN 30 ELSE 0 END + CASE WHEN num_bidders = 1 THEN 20 ELSE 0 END)",
    "CASE WHEN days < 3 OR score >= 80 THEN 'critical' WHEN days < 6 OR score >= 60 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END",
    "SELECT *, closing_date - publication_date AS days FROM tenders WHERE closing_date - publication_date < 7 AND estimated_value_mkd > 500000 AND status IN ('awarded', 'closed', 'completed')")
D6 = _sql("procedure_type", "CASE procedure_type WHEN 'NegotiatedProcedureWithoutPriorPublication' THEN 60 WHEN 'LowEstimatedValueProcedure' THEN 45 ELSE 35 END", _case((60, "high"), other="medium"),
    "SELECT * FROM tenders WHERE status IN ('awarded', 'completed') AND (procedure_type IN ('NegotiatedProcedureWithoutPriorPublication', 'QualificationSystem') OR procedure_type = 'LowEstimatedValueProcedure' AND estimated_value_mkd > 500000)")
D7 = _sql("identical_bids", "75 + CASE WHEN estimated_value_mkd > 0 AND ABS(bid_amount_mkd - estimated_value_mkd) / estimated_value_mkd < 0.01 THEN 15 ELSE 0 END", _case((85, "critical"), other="high"),
    "SELECT b.tender_id, bid_amount_mkd, estimated_value_mkd FROM (SELECT tender_id, bid_amount_mkd FROM bidders WHERE bid_amount_mkd > 0 GROUP BY tender_id, bid_amount_mkd HAVING COUNT(DISTINCT company_name) > 1) b JOIN tenders t ON b.tender_id = t.tender_id")


def _d8(rate: float, overlap: float) -> str:
    return _sql("professional_loser", "40 + CASE WHEN clustered THEN 20 ELSE 0 END", _case((55, "high"), other="medium"),
        f"""SELECT b.tender_id, EXISTS (SELECT 1 FROM {_pairs(5, overlap)} p WHERE (p.company_a = b.company_name AND p.company_b = t.winner) OR (p.company_b = b.company_name AND p.company_a = t.winner)) AS clustered
        FROM bidders b JOIN (SELECT company_name FROM bidders GROUP BY company_name HAVING COUNT(*) >= 10 AND SUM(CASE WHEN is_winner THEN 1 ELSE 0 END) / COUNT(*)::DOUBLE < {rate}) l ON b.company_name = l.company_name
        JOIN tenders t ON t.tender_id = b.tender_id WHERE NOT b.is_winner AND {WON}""")  # fmt: skip


def _d9(cap: float) -> str:
    return _sql("contract_splitting", "LEAST(100, 65 + CASE WHEN mx > 800000 THEN 15 ELSE 0 END + CASE WHEN n >= 5 THEN 10 ELSE 0 END)", _case((80, "critical"), other="high"),
        f"""SELECT tender_id, mx, n FROM (SELECT tender_id, COUNT(*) OVER w AS n, MAX(estimated_value_mkd) OVER w AS mx, SUM(estimated_value_mkd) OVER w AS total FROM tenders WHERE {WON} AND estimated_value_mkd > 0
        WINDOW w AS (PARTITION BY procuring_entity, winner, date_trunc('quarter', publication_date))) x WHERE n >= 3 AND mx < {cap} AND total > {cap}""")  # fmt: skip


D10 = _sql("short_decision", "LEAST(100, 45 + CASE WHEN days <= 1 THEN 20 ELSE 0 END + CASE WHEN num_bidders = 1 THEN 15 ELSE 0 END)", _case((75, "critical"), (60, "high"), other="medium"),
    "SELECT *, contract_signing_date - closing_date AS days FROM tenders WHERE contract_signing_date - closing_date BETWEEN 0 AND 2 AND status IN ('awarded', 'completed')")
D11 = """SELECT b.tender_id, 'strategic_disqualification' AS flag_type, 'high' AS severity, 70 AS score FROM bidders b JOIN tenders t ON t.tender_id = b.tender_id WHERE t.status IN ('awarded', 'completed') GROUP BY b.tender_id
  HAVING SUM(CASE WHEN disqualified THEN 1 ELSE 0 END) >= 2 AND SUM(CASE WHEN disqualified THEN 1 ELSE 0 END) = COUNT(*) - SUM(CASE WHEN is_winner THEN 1 ELSE 0 END)
UNION ALL SELECT b.tender_id, 'strategic_disqualification', 'medium', 55 FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY bid_amount_mkd, company_name) AS n FROM bidders WHERE bid_amount_mkd > 0) b
  JOIN tenders t ON t.tender_id = b.tender_id WHERE n = 1 AND disqualified AND t.status IN ('awarded', 'completed') AND evaluation_method ILIKE '%lowest%'"""
D12 = _sql("contract_value_growth", "LEAST(100, 40 + LEAST(40, CAST(FLOOR(overrun / 5) AS INTEGER)) + CASE WHEN amendment_count > 0 THEN 10 ELSE 0 END)", _case((75, "critical"), (60, "high"), (45, "medium"), other="low"),
    "SELECT *, (actual_value_mkd / estimated_value_mkd - 1) * 100 AS overrun FROM tenders WHERE estimated_value_mkd > 0 AND actual_value_mkd > estimated_value_mkd * 1.2::DOUBLE AND status IN ('awarded', 'completed')")


def _d13(low: int, high: int) -> str:
    return f"""SELECT arg_max(tender_id, seq) AS tender_id, 'bid_rotation' AS flag_type, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 65 THEN 'high' ELSE 'medium' END AS severity, s AS score FROM (
  SELECT *, CAST(LEAST(100, 55 + CASE WHEN total > 10000000 THEN 15 ELSE 0 END + CASE WHEN alt THEN 20 ELSE 0 END) AS INTEGER) AS s FROM (
    SELECT q.*, SUM(estimated_value_mkd) OVER e AS total, AVG(CASE WHEN q.winner = p2.winner THEN 1.0 ELSE 0.0 END) OVER e > 0.6 OR AVG(CASE WHEN q.winner = p3.winner THEN 1.0 ELSE 0.0 END) OVER e > 0.6 AS alt
    FROM (SELECT *, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date, tender_id) AS seq FROM tenders WHERE {WON}) q
    JOIN (SELECT procuring_entity FROM tenders WHERE {WON} GROUP BY procuring_entity HAVING COUNT(*) >= 10 AND COUNT(DISTINCT winner) BETWEEN {low} AND {high}) g ON g.procuring_entity = q.procuring_entity
    LEFT JOIN (SELECT procuring_entity, winner, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date, tender_id) AS seq FROM tenders WHERE {WON}) p2 ON p2.procuring_entity = q.procuring_entity AND p2.seq = (q.seq - 1) % 2 + 1
    LEFT JOIN (SELECT procuring_entity, winner, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date, tender_id) AS seq FROM tenders WHERE {WON}) p3 ON p3.procuring_entity = q.procuring_entity AND p3.seq = (q.seq - 1) % 3 + 1
    WINDOW e AS (PARTITION BY q.procuring_entity)) x) y GROUP BY procuring_entity, s"""


D14 = _sql("threshold_manipulation", "LEAST(100, 35 + CASE WHEN near_n >= 3 THEN 15 ELSE 0 END + CASE WHEN COALESCE(num_bidders = 1, FALSE) OR COALESCE(procedure_type LIKE '%Negotiated%', FALSE) THEN 20 ELSE 0 END)", _case((65, "high"), (50, "medium"), other="low"),
    """SELECT *, COUNT(*) OVER (PARTITION BY procuring_entity, th) AS near_n FROM (SELECT *, CASE """ + " ".join(f"WHEN estimated_value_mkd >= {t} * 0.95::DOUBLE AND estimated_value_mkd < {t} THEN {t}" for t in d.THRESHOLDS) + """ END AS th FROM tenders
    WHERE status IN ('awarded', 'completed', 'active', 'closed')) x WHERE th IS NOT NULL""")  # fmt: skip
D15 = _sql("late_amendment", "LEAST(100, 45 + CASE WHEN days < 0 THEN 25 ELSE 0 END + CASE WHEN num_bidders = 1 THEN 15 ELSE 0 END)", _case((75, "critical"), (60, "high"), other="medium"),
    "SELECT *, closing_date - last_amendment_date AS days FROM tenders WHERE amendment_count > 0 AND closing_date - last_amendment_date <= 3 AND status IN ('awarded', 'completed', 'active', 'closed')")

_ALL = {"d1": D1, "d2": _d2(60, 5), "d3": _d3(0.05), "d4": _d4(70), "d5": D5, "d6": D6, "d7": D7, "d8": _d8(0.05, 70), "d9": _d9(1e6), "d10": D10, "d11": D11, "d12": D12, "d13": _d13(2, 5), "d14": D14, "d15": D15}
#: The flags of all detectors, as a common table expression to follow DOMAIN_SQL.
FLAGS_SQL = DOMAIN_SQL + ",\nflags AS (\n" + "\nUNION ALL\n".join(f"SELECT tender_id, flag_type, severity, score FROM ({q}) {k}" for k, q in _ALL.items()) + ")\n"
_WEIGHT = "CASE flag_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in d.WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
CRI_SQL = f"""cri AS (
  SELECT tender_id, flag_types, CAST(LEAST(100, CAST(FLOOR(ROUND(sw / w, 10) + 8 * (flag_types - 1)) AS INTEGER)) AS INTEGER) AS cri FROM (
    SELECT tender_id, COUNT(*) AS flag_types, SUM(score * {_WEIGHT}) AS sw, SUM({_WEIGHT}) AS w FROM (SELECT tender_id, flag_type, MAX(score) AS score FROM flags GROUP BY tender_id, flag_type) p GROUP BY tender_id) q)
"""
_LEVEL = "CASE WHEN cri >= 80 THEN 'critical' WHEN cri >= 60 THEN 'high' WHEN cri >= 40 THEN 'medium' WHEN cri >= 20 THEN 'low' ELSE 'minimal' END AS risk_level"


def flag_tables(t: Tables) -> tuple[Tables, DataFrame]:
    """Tables whose tenders and bidders are written once, and all their flags, written too."""
    own = t.written()
    return own, materialize(d.all_flags(own.tenders, own.bidders), "flags")


def d17_full_run(t: Tables) -> DataFrame:
    """Flags and affected tenders per type."""
    _, flags = flag_tables(t)
    return flags.groupBy("flag_type").agg(F.count(F.lit(1)).alias("flags"), F.count_distinct("tender_id").alias("tenders"))


def r1_rollup(t: Tables) -> DataFrame:
    own, flags = flag_tables(t)
    return d.flagged_rollup(flags, own.tenders)


QUERIES = {
    "d1_single_bidder": lambda t: _flags(d.single_bidder(t.tenders)),
    "d2_repeat_winner": lambda t: _flags(d.repeat_winner(t.tenders)),
    "d2_repeat_winner_20": lambda t: _flags(d.repeat_winner(t.tenders, least_share=20.0)),
    "d3_price_anomaly": lambda t: _flags(d.price_anomaly(t.tenders, t.bidders)),
    "d3_price_anomaly_cov20": lambda t: _flags(d.price_anomaly(t.tenders, t.bidders, low_cov=0.20)),
    "d4_bid_clustering": lambda t: _flags(d.bid_clustering(t.tenders, t.bidders)),
    "d4_bid_clustering_45": lambda t: _flags(d.bid_clustering(t.tenders, t.bidders, least_overlap=45.0)),
    "d5_short_deadline": lambda t: _flags(d.short_deadline(t.tenders)),
    "d6_procedure_type": lambda t: _flags(d.procedure_type(t.tenders)),
    "d7_identical_bids": lambda t: _flags(d.identical_bids(t.tenders, t.bidders)),
    "d8_professional_loser": lambda t: _flags(d.professional_loser(t.tenders, t.bidders)),
    "d8_professional_loser_9": lambda t: _flags(d.professional_loser(t.tenders, t.bidders, most_win_rate=0.09, least_overlap=45.0)),
    "d9_contract_splitting": lambda t: _flags(d.contract_splitting(t.tenders)),
    "d9_contract_splitting_9m": lambda t: _flags(d.contract_splitting(t.tenders, cap=9e6, least_sum=9e6)),
    "d10_short_decision": lambda t: _flags(d.short_decision(t.tenders)),
    "d11_strategic_disqualification": lambda t: _flags(d.strategic_disqualification(t.tenders, t.bidders)),
    "d12_contract_value_growth": lambda t: _flags(d.contract_value_growth(t.tenders)),
    "d13_bid_rotation": lambda t: _flags(d.bid_rotation(t.tenders)),
    "d13_bid_rotation_2_7": lambda t: _flags(d.bid_rotation(t.tenders, winners=(2, 7))),
    "d14_threshold_manipulation": lambda t: _flags(d.threshold_manipulation(t.tenders)),
    "d15_late_amendment": lambda t: _flags(d.late_amendment(t.tenders)),
    "d16_risk_index": lambda t: d.risk_index(flag_tables(t)[1]),
    "d17_full_run": d17_full_run,
    "r1_flagged_rollup": r1_rollup,
}

ORACLES = {
    "d1_single_bidder": DOMAIN_SQL + D1,
    "d2_repeat_winner": DOMAIN_SQL + _d2(60, 5),
    "d2_repeat_winner_20": DOMAIN_SQL + _d2(20, 5),
    "d3_price_anomaly": DOMAIN_SQL + _d3(0.05),
    "d3_price_anomaly_cov20": DOMAIN_SQL + _d3(0.20),
    "d4_bid_clustering": DOMAIN_SQL + _d4(70),
    "d4_bid_clustering_45": DOMAIN_SQL + _d4(45),
    "d5_short_deadline": DOMAIN_SQL + D5,
    "d6_procedure_type": DOMAIN_SQL + D6,
    "d7_identical_bids": DOMAIN_SQL + D7,
    "d8_professional_loser": DOMAIN_SQL + _d8(0.05, 70),
    "d8_professional_loser_9": DOMAIN_SQL + _d8(0.09, 45),
    "d9_contract_splitting": DOMAIN_SQL + _d9(1e6),
    "d9_contract_splitting_9m": DOMAIN_SQL + _d9(9e6),
    "d10_short_decision": DOMAIN_SQL + D10,
    "d11_strategic_disqualification": DOMAIN_SQL + D11,
    "d12_contract_value_growth": DOMAIN_SQL + D12,
    "d13_bid_rotation": DOMAIN_SQL + _d13(2, 5),
    "d13_bid_rotation_2_7": DOMAIN_SQL + _d13(2, 7),
    "d14_threshold_manipulation": DOMAIN_SQL + D14,
    "d15_late_amendment": DOMAIN_SQL + D15,
    "d16_risk_index": FLAGS_SQL + "," + CRI_SQL + f"SELECT tender_id, cri, flag_types, {_LEVEL} FROM cri",
    "d17_full_run": FLAGS_SQL + "SELECT flag_type, COUNT(*) AS flags, COUNT(DISTINCT tender_id) AS tenders FROM flags GROUP BY flag_type",
    "r1_flagged_rollup": FLAGS_SQL + "," + CRI_SQL + f"""
SELECT p.tender_id, total_flags, severity_rank, max_score, types, flag_types, cri, {_LEVEL}, procuring_entity, winner, estimated_value_mkd, status FROM (
  SELECT tender_id, COUNT(*) AS total_flags, MAX(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity_rank, MAX(score) AS max_score, string_agg(DISTINCT flag_type, ',' ORDER BY flag_type) AS types
  FROM flags GROUP BY tender_id) p JOIN cri ON cri.tender_id = p.tender_id JOIN tenders t ON t.tender_id = p.tender_id""",
}
