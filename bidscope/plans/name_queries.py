"""Registered queries of names: keys of titles and buyers, names of code divisions, searches and alerts in both scripts, competition."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.functions import cleaning as c
from bidscope.operators import entities as e
from bidscope.operators import feature_sets as fs
from bidscope.operators import panels as p
from bidscope.operators import risk as r
from bidscope.plans.detector_queries import FLAGS_SQL, flag_tables
from bidscope.sources.domain import DOMAIN_SQL



def _titles(t):
    """Titles with spaces, punctuation and capitals that the key leaves out, and buyers with a legal form and a city."""
    shown = F.concat(F.lit("  "), F.upper("title"), F.lit("  (бр. 1); "))
    buyer = F.concat(F.lit("ЈКП  "), "procuring_entity", F.lit(" Скопје"))
    return t.tenders.select("tender_id", e.normalized_title(shown).alias("title_key"), e.normalized_buyer(buyer).alias("buyer_key"))


def _divisions(t):
    code = F.col("cpv_code")
    return t.tenders.filter("cpv_code is not null").groupBy(F.substring(code, 1, 2).alias("division"), c.cpv_name(code).alias("name")).agg(F.count(F.lit(1)).alias("tenders"), F.sum("estimated_value_mkd").alias("estimated"))


def _both_scripts(t):
    """Tenders whose odd half is written in Cyrillic."""
    odd = F.pmod(F.length("tender_id"), F.lit(2)) == 1
    names = {n: F.when(odd, c.transliterate(F.col(n))).otherwise(F.col(n)) for n in ("title", "category", "procuring_entity")}
    return t.tenders.withColumns(names)


def _tracked(t):
    """Searches with a keyword of three letters or more, a competitor, and open bounds of the value."""
    n = F.col("n_nationkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("plate", "gear", "tin", "bolt")]), (n % 4 + 1).cast("int"))
    return t.raw("nation").select(
        n.cast("long").alias("alert_id"), word.alias("keyword"), F.concat(F.lpad((n + 1).cast("string"), 2, "0"), F.lit("00")).alias("cpv4"), F.concat("n_name", F.lit("|")).alias("buyer"),
        F.when(n % 3 > 0, 1e6).alias("low"), F.when(n % 3 < 2, 4e6).alias("high"), F.concat(F.lit("co-"), n.cast("string")).alias("competitor"),
    )


def _flagged(t):
    own, flags = flag_tables(t)
    return p.flag_search(flags, own.tenders, severities=("critical", "high"), flag_type="short_deadline", least_score=60, buyer="Nation_1", winner="co-")


def _cyrillic_sql(column: str) -> str:
    text = f"lower({column})"
    for latin, cyrillic in c.DIGRAPHS:
        text = f"replace({text}, '{latin}', '{cyrillic}')"
    return f"translate({text}, '{c.LATIN}', '{c.CYRILLIC}')"


_HIT = " OR ".join(
    f"CASE WHEN length(keyword) > 3 THEN contains(x, {k}) ELSE list_contains(string_split_regex(x, '[^\\p{{L}}\\p{{N}}_]+'), {k}) END" for k in ("keyword", _cyrillic_sql("keyword"))
)

_ALL = {
    "c13_title_and_buyer_keys": (_titles, DOMAIN_SQL + """
SELECT tender_id, regexp_replace(regexp_replace(trim(lower(COALESCE('  ' || upper(title) || '  (бр. 1); ', ''))), '\\s+', ' ', 'g'), '[.,;:!?\\-–—''"()\\[\\]{}]', '', 'g') AS title_key, regexp_replace(lower(COALESCE(procuring_entity, '')), '\\s+', ' ', 'g') AS buyer_key
FROM tenders"""),
    "c16_division_names": (_divisions, DOMAIN_SQL + ", names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in c.CPV_DIVISIONS.items()) + """) v(division, name))
SELECT left(cpv_code, 2) AS division, name, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS estimated FROM tenders LEFT JOIN names ON division = left(cpv_code, 2) WHERE cpv_code IS NOT NULL GROUP BY 1, 2"""),
    "r5_flag_search_by_name": (_flagged, FLAGS_SQL + """
SELECT f.tender_id, score, types, procuring_entity, winner
FROM (SELECT tender_id, MAX(CASE WHEN severity IN ('critical', 'high') THEN score END) AS score, string_agg(DISTINCT flag_type, ',' ORDER BY flag_type) AS types, bool_or(flag_type = 'short_deadline') AS hit FROM flags GROUP BY 1) f
JOIN tenders t ON t.tender_id = f.tender_id WHERE hit AND score >= 60 AND contains(lower(procuring_entity), 'nation_1') AND contains(lower(winner), 'co-')"""),
    "r16_alert_matches_both_scripts": (lambda t: r.match_alerts(_both_scripts(t), _tracked(t)), DOMAIN_SQL + f"""
, subs AS (
  SELECT n_nationkey AS alert_id, CASE n_nationkey % 4 WHEN 0 THEN 'plate' WHEN 1 THEN 'gear' WHEN 2 THEN 'tin' ELSE 'bolt' END AS keyword, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '00' AS cpv4, lower(n_name) || '|' AS buyer,
         CASE WHEN n_nationkey % 3 > 0 THEN 1e6 ELSE 0 END AS low, CASE WHEN n_nationkey % 3 < 2 THEN 4e6 ELSE 1e300 END AS high, 'co-' || n_nationkey AS competitor FROM nation),
tt AS (
  SELECT tender_id, cpv_code, lower(winner) AS w, COALESCE(estimated_value_mkd, 0) AS v, CASE WHEN odd THEN {_cyrillic_sql("both_texts")} ELSE lower(both_texts) END AS x, CASE WHEN odd THEN {_cyrillic_sql("procuring_entity")} ELSE lower(procuring_entity) END AS b
  FROM (SELECT *, concat_ws(' ', title, category) AS both_texts, length(tender_id) % 2 = 1 AS odd FROM tenders) z)
SELECT tender_id, CAST(alert_id AS BIGINT) AS alert_id, CAST(LEAST(points, 100) AS INTEGER) AS match_score
FROM (SELECT tender_id, alert_id, CASE WHEN {_HIT} THEN 25 ELSE 0 END + CASE WHEN starts_with(cpv_code, cpv4) THEN 30 ELSE 0 END + CASE WHEN contains(b, buyer) THEN 25 ELSE 0 END
             + CASE WHEN v BETWEEN low AND high THEN 20 ELSE 0 END + CASE WHEN contains(w, competitor) THEN 25 ELSE 0 END AS points FROM tt, subs) s
WHERE points >= 25"""),
    "m1_competition_set": (lambda t: fs.competition_feature_set(t.tenders, t.bidders), DOMAIN_SQL + """
, per AS (
  SELECT tender_id, COUNT(*) AS n, SUM(CASE WHEN disqualified THEN 1 ELSE 0 END) AS o, SUM(bid_amount_mkd) AS v, SUM(bid_amount_mkd * bid_amount_mkd) AS vv, MIN(CASE WHEN is_winner THEN rank END) AS win_at FROM bidders GROUP BY 1),
bm AS (SELECT procuring_entity, AVG(num_bidders) AS m FROM tenders WHERE num_bidders > 0 AND status IN ('awarded', 'closed') GROUP BY 1),
cm AS (SELECT category, AVG(num_bidders) AS m FROM tenders WHERE num_bidders > 0 AND status IN ('awarded', 'closed') GROUP BY 1),
db AS (SELECT b.tender_id, company_name, publication_date, MIN(publication_date) OVER (PARTITION BY procuring_entity, company_name) AS f FROM bidders b JOIN tenders t ON t.tender_id = b.tender_id),
nw AS (SELECT tender_id, COUNT(*) AS new FROM db WHERE publication_date = f GROUP BY 1),
tot AS (SELECT company_name, COUNT(*) AS c FROM bidders GROUP BY 1),
pr AS (SELECT x.tender_id, x.company_name AS a, y.company_name AS b, COUNT(*) OVER (PARTITION BY x.company_name, y.company_name) AS met FROM bidders x JOIN bidders y ON x.tender_id = y.tender_id AND x.company_name < y.company_name),
hb AS (SELECT tender_id, AVG(met / LEAST(p.c, q.c)) AS habit FROM pr JOIN tot p ON p.company_name = a JOIN tot q ON q.company_name = b GROUP BY 1)
SELECT t.tender_id, CAST(COALESCE(n, 0) AS DOUBLE) AS num_bidders, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END AS single_bidder, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE 0 END AS no_bidders, CASE WHEN n = 2 THEN 1.0::DOUBLE ELSE 0 END AS two_bidders,
       ROUND(COALESCE(COALESCE(n, 0) / bm.m, 0), 6) AS bidders_vs_institution_avg, ROUND(COALESCE(COALESCE(n, 0) / cm.m, 0), 6) AS bidders_vs_category_avg, CAST(COALESCE(o, 0) AS DOUBLE) AS num_disqualified, ROUND(COALESCE(o / n, 0), 6) AS disqualification_rate,
       CAST(COALESCE(CASE WHEN winner IS NOT NULL THEN win_at END, 0) AS DOUBLE) AS winner_rank, CASE WHEN winner IS NOT NULL AND win_at > 1 THEN 1.0::DOUBLE ELSE 0 END AS winner_not_lowest, ROUND(COALESCE(vv * 10000 / NULLIF(v * v, 0), 0), 6) AS market_concentration_hhi,
       CAST(COALESCE(new, 0) AS DOUBLE) AS new_bidders_count, ROUND(COALESCE(new / n, 0), 6) AS new_bidders_ratio, ROUND(COALESCE(habit, 0), 6) AS bidder_clustering_score
FROM tenders t LEFT JOIN per USING (tender_id) LEFT JOIN bm USING (procuring_entity) LEFT JOIN cm USING (category) LEFT JOIN nw USING (tender_id) LEFT JOIN hb USING (tender_id)"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
