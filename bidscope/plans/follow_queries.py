"""Registered queries of alerts' follow-up, features, edges, text measures and incremental jobs, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bidscope.functions import relevance as v
from bidscope.functions import text as x
from bidscope.operators import follow_up as u
from bidscope.operators import graph as g
from bidscope.operators import risk as r
from bidscope.plans.detector_queries import CRI_SQL, FLAGS_SQL
from bidscope.plans.other_queries import ORACLES as OTHER_SQL
from bidscope.plans.other_queries import R12_SQL, _subscriptions, _with_flags
from bidscope.sources.domain import AS_OF, DOMAIN_SQL
from bidscope.streaming import incremental as s

D = "::DOUBLE"
AW = "status IN ('awarded', 'completed')"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
R12 = R12_SQL
R16 = OTHER_SQL["r16_alert_matches"]
QUERY = "steel gear"
CODES = {"33000000": {"tion": 2, "the": 1}, "45000000": {"der": 2, "ein": 2}, "72000000": {"que": 3, "ción": 2}}


def _users(t):
    """Buyers' nations as users, each following two rules from a severity on."""
    n = t.raw("nation")
    k = F.col("n_nationkey")
    follows = F.explode(F.when(k % 2 == 0, F.array(F.lit("high_risk_score"), F.lit("multiple_flags"))).otherwise(F.array(F.lit("repeat_pattern"), F.lit("single_bidder_high_value"))))
    return n.select(F.col("n_name").alias("user_id"), F.when(k % 3 == 0, "critical").when(k % 3 == 1, "high").otherwise("low").alias("least"), follows.alias("rule"))


_USERS = """SELECT n_name AS user_id, CASE n_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS least, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['high_risk_score', 'multiple_flags'] ELSE ['repeat_pattern', 'single_bidder_high_value'] END) AS rule FROM nation"""


def _due(flags, t):
    users = _users(t)
    sent = t.tenders.filter("tender_id like '%1'").select("tender_id").crossJoin(F.broadcast(users.select("user_id", "rule")))  # 25 users
    return u.due_alerts(r.alerts(flags, t.tenders), users, sent).groupBy("user_id", "rule", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def _verdicts(flags, t):
    n = F.substring("tender_id", -1, 1).cast("int")
    times = F.explode(F.sequence(F.lit(0), n % 3)).alias("k")
    return u.verification_summary(flags.select("flag_type", "tender_id", n.alias("n"), times).select("flag_type", "tender_id", ((F.col("n") + F.col("k")) % 4 == 0).alias("confirmed")))


def _tips(t):
    i = F.col("doc_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("bid_rigging", "bribery", "fraud", "general")]), (i % 4 + 1).cast("int"))
    return u.tip_scores(t.raw("documents").select("doc_id", "text", kinds.alias("category"), (i % 3).alias("matched_tenders"), (i % 5).alias("matched_entities")))


def _matches(t):
    return r.match_alerts(t.tenders, _subscriptions(t))


def _predictions(t):
    """Two models' predictions of each tender."""
    model = F.explode(F.array(F.lit(0), F.lit(1))).alias("m")
    rows = t.tenders.select("tender_id", "closing_date", F.col("amendment_count").alias("a"), F.coalesce("num_bidders", F.lit(0)).alias("b"), model)
    return rows.select("tender_id", F.date_add("closing_date", F.col("m") * F.col("a")).alias("made_on"), F.concat(F.lit("model "), "m").alias("model"), ((F.col("b") * 17 + F.col("a") * 29 + F.col("m") * 13) % 101).cast("int").alias("score"))


def _trade(t):
    """Orders between customers and suppliers one way, returned ones the other way."""
    o = t.raw("orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("c"))
    line = t.raw("lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("S"), "l_suppkey").alias("s"))
    back = F.col("l_returnflag") == "R"
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.when(back, F.col("s")).otherwise(F.col("c")).alias("src"), F.when(back, F.col("c")).otherwise(F.col("s")).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


_TRADE = "SELECT CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS src, CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS dst, COUNT(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def _clusters(t):
    """Companies that met in a category and nation, a cluster for each such pair of companies that recurs there."""
    j = t.bidders.join(t.tenders.select("tender_id", "cpv_code"), "tender_id").filter("cpv_code is not null")
    often = j.groupBy("cpv_code", "company_name").agg(F.count_if("is_winner").alias("n")).filter("n >= 14")
    return often.select(F.col("cpv_code").alias("cluster"), F.col("company_name").alias("member"))


_CLUSTERS = """, mem AS MATERIALIZED (SELECT cpv_code AS cluster, company_name AS member FROM bidders JOIN tenders USING (tender_id) WHERE cpv_code IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE is_winner) >= 14),
    sz AS (SELECT cluster, COUNT(*) AS n FROM mem GROUP BY 1),
    lk AS MATERIALIZED (SELECT a.cluster AS a, b.cluster AS b FROM mem a JOIN mem b ON a.member = b.member AND a.cluster <> b.cluster JOIN sz x ON x.cluster = a.cluster JOIN sz y ON y.cluster = b.cluster
                        GROUP BY a.cluster, b.cluster, x.n, y.n HAVING COUNT(*) / (x.n + y.n - COUNT(*)) >= 0.6),
    reach AS (SELECT cluster, cluster AS other FROM sz UNION SELECT r.cluster, lk.b FROM reach r JOIN lk ON r.other = lk.a),
    merged AS (SELECT DISTINCT root AS cluster, member FROM mem JOIN (SELECT cluster, MIN(other) AS root FROM reach GROUP BY 1) z USING (cluster))"""


def _required(t):
    kinds = [("Open", "short"), ("Open", "long"), ("SimplifiedOpenProcedure", "long"), ("QualificationSystem", "short"), ("QualificationSystem", "medium"), ("QualificationSystem", "long")]
    return t.spark.createDataFrame(kinds, "procedure_type string, kind string")


def _tender_documents(t):
    n = t.raw("orders").count()
    return t.raw("documents").withColumn("tender_id", F.concat(F.lit("T"), F.col("doc_id") % (n // 50 + 1)))


_DOCS = ", n AS (SELECT COUNT(*) // 50 + 1 AS n FROM orders), dt AS (SELECT d.*, 'T' || (doc_id % n) AS tender_id FROM documents d, n)"


def _kinds(t):
    size = F.length(F.coalesce("text", F.lit("")))
    return _tender_documents(t).select("tender_id", F.when(size < 300, "short").when(size < 1000, "medium").otherwise("long").alias("kind"))


def _uploads(t):
    d = _tender_documents(t).join(t.tenders.select("tender_id", "closing_date"), "tender_id")
    return d.select("tender_id", "text", F.date_add("closing_date", (F.col("doc_id") % 5 - 3).cast("int")).alias("uploaded"), "closing_date")


def _entity_sql(kind):
    return f"SELECT doc_id, '{kind}' AS entity_type, unnest(list_distinct(regexp_extract_all(text, '{x.ENTITIES[kind]}'))) AS entity FROM documents"


_ENTITIES = "(" + " UNION ALL ".join(_entity_sql(k) for k in x.ENTITIES) + ")"
_TRI = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"


def _likeness(column):
    a, b = _TRI.format(column), _TRI.format(f"'{QUERY}'")
    return f"COALESCE(len(list_intersect({a}, {b})) / NULLIF(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


_WORDS = "string_split_regex(lower(COALESCE({0}, '')), '[^\\p{{L}}\\p{{N}}]+')"


def _rank(column, weight):
    return " + ".join(f"CASE WHEN list_contains({_WORDS.format(column)}, '{w}') THEN {weight}{D} / 2 ELSE 0 END" for w in QUERY.split())


_ALL = {
    "r3_high_risk": (_with_flags(lambda f, t: u.high_risk(f, t.tenders)), FLAGS_SQL + f"""
    SELECT f.tender_id, types, score, worst, procuring_entity, winner, estimated_value_mkd
    FROM (SELECT tender_id, string_agg(DISTINCT flag_type, ',' ORDER BY flag_type) AS types, MAX(score) AS score, MAX({RANK}) AS worst FROM flags GROUP BY 1) f JOIN tenders t ON t.tender_id = f.tender_id WHERE worst >= 3"""),
    "r13_enriched_alerts": (_with_flags(lambda f, t: u.enriched_alerts(r.risk_index(f).select("tender_id", F.col("cri").alias("score")), t.tenders)), FLAGS_SQL + "," + CRI_SQL + """
    , o AS (SELECT t.procuring_entity, cri, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date DESC NULLS LAST, t.tender_id) AS n FROM cri JOIN tenders t ON t.tender_id = cri.tender_id),
    h AS (SELECT *, COUNT(*) OVER (PARTITION BY procuring_entity) AS al FROM o WHERE n <= 10),
    m AS (SELECT procuring_entity, MAX(al) AS al, AVG(CASE WHEN n <= al // 2 THEN cri END) - AVG(CASE WHEN n > al // 2 THEN cri END) AS move FROM h GROUP BY 1)
    SELECT t.tender_id, CASE WHEN winner IS NULL THEN 0 ELSE rep END AS repeat_wins, CASE WHEN al < 3 THEN 'stable' WHEN move > 5 THEN 'increasing' WHEN move < -5 THEN 'decreasing' ELSE 'stable' END AS trend
    FROM (SELECT *, COUNT(*) FILTER (WHERE status = 'awarded') OVER (PARTITION BY procuring_entity, winner) AS rep FROM tenders) t JOIN cri ON cri.tender_id = t.tender_id JOIN m ON m.procuring_entity = t.procuring_entity"""),
    "r14_due_alerts": (_with_flags(_due), f"""
    SELECT user_id, a.rule, severity, COUNT(*) AS alerts FROM (SELECT DISTINCT * FROM ({R12}) q) a JOIN ({_USERS}) f ON f.rule = a.rule AND {RANK} >= least WHERE tender_id NOT LIKE '%1' GROUP BY 1, 2, 3"""),
    "r15_alert_statistics": (_with_flags(lambda f, t: u.alert_statistics(r.alerts(f, t.tenders))), f"""
    SELECT 'severity' AS grain, severity AS name, COUNT(*) AS alerts, COUNT(DISTINCT tender_id) AS tenders FROM ({R12}) a GROUP BY 2
    UNION ALL SELECT 'rule', rule, COUNT(*), COUNT(DISTINCT tender_id) FROM ({R12}) b GROUP BY 2"""),
    "r17_briefings": (lambda t: u.briefings(_matches(t)), f"""
    SELECT m.alert_id, COUNT(*) AS matches, COUNT(*) FILTER (WHERE match_score >= 75) AS high, COUNT(*) FILTER (WHERE match_score >= 50 AND match_score < 75) AS medium, COUNT(*) FILTER (WHERE match_score < 50) AS low, ANY_VALUE(first) AS first
    FROM ({R16}) m JOIN (SELECT alert_id, string_agg(tender_id, ',' ORDER BY place) AS first
                         FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY match_score DESC, tender_id) AS place FROM ({R16}) q) p WHERE place <= 3 GROUP BY 1) f ON f.alert_id = m.alert_id GROUP BY 1"""),
    "r18_unread_matches": (lambda t: u.unread_matches(_matches(t), _matches(t).filter("tender_id like '%2' or alert_id < 5").select("alert_id", "tender_id"), t.tenders), DOMAIN_SQL + f"""
    SELECT tender_id, alert_id, match_score, title, closing_date FROM ({R16}) m JOIN (SELECT tender_id, title, closing_date FROM tenders WHERE status = 'open') t USING (tender_id) WHERE tender_id NOT LIKE '%2' AND alert_id >= 5"""),
    "r19_tip_scores": (_tips, f"""
    WITH t AS (
      SELECT doc_id, ['bid_rigging', 'bribery', 'fraud', 'general'][doc_id % 4 + 1] AS category, doc_id % 3 AS mt, doc_id % 5 AS me, length(COALESCE(text, '')) AS l, len(regexp_extract_all(COALESCE(text, ''), '[A-Z][a-z]+ [A-Z][a-z]+')) AS n,
             len(regexp_extract_all(COALESCE(text, ''), '[0-9]{{1,3}}(?:[.,][0-9]{{3}})+')) AS a, len(regexp_extract_all(COALESCE(text, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS d, len(regexp_extract_all(COALESCE(text, ''), 'https?://')) AS k FROM documents),
    p AS (
      SELECT *, 0.25{D} * CASE WHEN l > 0 THEN LEAST(ln(l + 1) / ln(1001), 1) ELSE 0 END + 0.2{D} * LEAST(n * 0.2{D}, 1) + 0.2{D} * LEAST(mt * 0.5{D}, 1) + 0.1{D} * LEAST(a * 0.5{D}, 1) + 0.1{D} * LEAST(d * 0.33{D}, 1) + 0.15{D} * LEAST(k * 0.5{D}, 1) AS detail,
             0.4{D} * LEAST(mt * 0.3{D}, 1) + 0.3{D} * LEAST(me * 0.25{D}, 1) + 0.15{D} * LEAST(a * 0.5{D}, 1) + 0.15{D} * LEAST(d * 0.33{D}, 1) AS specific FROM t),
    q AS (
      SELECT *, ROUND(GREATEST(0, LEAST(100, (0.35{D} * LEAST(detail, 1) + 0.4{D} * LEAST(specific, 1)) * 100 + LEAST(k, 3) * 5 + CASE category WHEN 'bid_rigging' THEN 8 WHEN 'bribery' THEN 7 WHEN 'fraud' THEN 7 ELSE 0 END
             + LEAST(mt * 3 + me * 2, 15))), 6) AS triage FROM p)
    SELECT doc_id, triage, ['low', 'medium', 'high', 'critical'][LEAST(3, CASE WHEN triage >= 75 THEN 3 WHEN triage >= 55 THEN 2 WHEN triage >= 30 THEN 1 ELSE 0 END + CASE WHEN category = 'bribery' OR a > 0 THEN 1 ELSE 0 END) + 1] AS urgency FROM q"""),
    "r21_verification_summary": (_with_flags(_verdicts), FLAGS_SQL + f"""
    , w AS (SELECT flag_type, tender_id, CAST(substr(tender_id, -1) AS INTEGER) AS n FROM flags),
    x AS (SELECT flag_type, tender_id, COUNT(*) AS c, COUNT(*) FILTER (WHERE (n + k) % 4 = 0) AS yes FROM w, (VALUES (0), (1), (2)) v(k) WHERE k <= n % 3 GROUP BY 1, 2)
    SELECT flag_type, SUM(c) AS verdicts, SUM(yes) AS confirmed, ROUND(SUM(yes) * 100.0{D} / SUM(c), 4) AS share, COUNT(*) FILTER (WHERE yes > 0 AND yes < c) AS disputed FROM x GROUP BY 1"""),
    "m2_price_features": (lambda t: u.price_features(t.tenders, t.bidders), f"""
    , b AS (SELECT *, bid_amount_mkd - lag(bid_amount_mkd) OVER w AS gap, row_number() OVER w AS place FROM bidders WINDOW w AS (PARTITION BY tender_id ORDER BY bid_amount_mkd, company_name)),
    p AS (SELECT tender_id, COUNT(*) AS bids, MIN(bid_amount_mkd) AS lo, MAX(bid_amount_mkd) AS hi, AVG(bid_amount_mkd) AS m, stddev_pop(bid_amount_mkd) AS sd, quantile_cont(bid_amount_mkd, 0.25) AS q1, quantile_cont(bid_amount_mkd, 0.75) AS q3,
                 MAX(CASE WHEN place = 2 THEN gap END) AS g1, MIN(gap) AS g0, COUNT(*) FILTER (WHERE bid_amount_mkd % 1000 = 0) AS round_bids, MAX(CASE WHEN is_winner THEN bid_amount_mkd END) AS w FROM b GROUP BY 1)
    SELECT tender_id, bids, ROUND(sd / NULLIF(m, 0), 6) AS cov, ROUND((q3 - q1) / NULLIF(m, 0), 4) AS iqr, g1 AS first_gap, g0 AS least_gap, round_bids, ROUND(w / NULLIF(estimated_value_mkd, 0), 6) AS winning_to_estimate,
           ROUND(lo / NULLIF(estimated_value_mkd, 0), 6) AS low_to_estimate, ROUND((m - w) / NULLIF(sd, 0), 6) AS winner_z, w = lo AS lowest_won FROM tenders JOIN p USING (tender_id)"""),
    "m3_timing_features": (lambda t: u.timing_features(t.tenders), """
    SELECT tender_id, closing_date - publication_date AS open_days, contract_signing_date - closing_date AS decision_days, closing_date - publication_date < 7 AS short, isodow(publication_date) >= 6 AS weekend, quarter(publication_date) AS quarter,
           month(publication_date) = 12 AS year_end, closing_date - last_amendment_date AS since_amendment, day(publication_date) >= 25 AS month_end FROM tenders"""),
    "m5_procedural_features": (lambda t: u.procedural_features(t.tenders), """
    SELECT tender_id, CAST(procedure_type LIKE '%Negotiated%' AS INTEGER) AS negotiated, CAST(procedure_type LIKE 'LowEstimated%' AS INTEGER) AS low_value, CAST(procedure_type = 'Open' AS INTEGER) AS open,
           CAST(evaluation_method LIKE '%lowest%' AS INTEGER) AS lowest_price, amendment_count, CAST(amendment_count > 2 AS INTEGER) AS many_amendments, CAST(winner IS NOT NULL AS INTEGER) AS has_winner, CAST(estimated_value_mkd > 5e6 AS INTEGER) AS large FROM tenders"""),
    "m6_document_features": (lambda t: u.document_features(_tender_documents(t)), _DOCS + """
    SELECT tender_id, COUNT(*) AS documents, SUM(length(COALESCE(text, ''))) AS characters, ROUND(AVG(length(COALESCE(text, ''))), 4) AS mean_length, MAX(length(COALESCE(text, ''))) AS longest,
           COUNT(*) FILTER (WHERE length(COALESCE(text, '')) < 100) AS tiny, COUNT(*) - COUNT(DISTINCT COALESCE(text, '')) AS repeated FROM dt GROUP BY 1"""),
    "m7_history_features": (lambda t: u.history_features(t.tenders, AS_OF), """
    , p AS (SELECT procuring_entity, CAST(date_trunc('month', publication_date) AS DATE) AS mo, COUNT(*) AS n FROM tenders GROUP BY 1, 2),
    q AS (SELECT *, CASE WHEN lag(mo) OVER w = CAST(mo - INTERVAL 1 MONTH AS DATE) THEN lag(n) OVER w ELSE 0 END AS before, COALESCE(n > 2 * AVG(n) OVER (PARTITION BY procuring_entity ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS spike
          FROM p WINDOW w AS (PARTITION BY procuring_entity ORDER BY mo))
    SELECT tender_id, DATE '2001-08-01' - publication_date AS age, n AS in_month, before AS month_before, spike FROM tenders t JOIN q ON q.procuring_entity = t.procuring_entity AND mo = date_trunc('month', publication_date)"""),
    "m9_batch_features": (lambda t: u.batch_features(t.tenders), f"""
    SELECT tender_id, ROUND(ln(1 + estimated_value_mkd), 6) AS log_value, COALESCE(num_bidders, 0) AS bidders, closing_date - publication_date AS open_days, amendment_count, COUNT(*) OVER b AS buyer_tenders,
           ROUND(AVG(CASE WHEN num_bidders = 1 THEN 1.0{D} ELSE 0 END) OVER b, 6) AS buyer_single_rate, CASE WHEN winner IS NOT NULL THEN COUNT(CASE WHEN {AW} THEN 1 END) OVER w END AS winner_awards,
           CASE WHEN winner IS NOT NULL THEN COUNT(CASE WHEN {AW} THEN 1 END) OVER p END AS pair_awards FROM tenders
    WINDOW b AS (PARTITION BY procuring_entity ORDER BY publication_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), w AS (PARTITION BY winner ORDER BY publication_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
           p AS (PARTITION BY procuring_entity, winner ORDER BY publication_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
    "m26_latest_predictions": (lambda t: u.latest_predictions(_predictions(t), date(1997, 1, 1), 60), """
    , p AS (SELECT tender_id, closing_date + CAST(m * amendment_count AS INTEGER) AS made_on, 'model ' || m AS model, CAST((COALESCE(num_bidders, 0) * 17 + amendment_count * 29 + m * 13) % 101 AS INTEGER) AS score FROM tenders, (VALUES (0), (1)) v(m))
    SELECT *, CASE WHEN score >= 80 THEN 'critical' ELSE 'high' END AS level
    FROM (SELECT tender_id, MAX(made_on) AS made_on, arg_max(model, (made_on, model)) AS model, arg_max(score, (made_on, model)) AS score FROM p GROUP BY 1) z WHERE made_on >= DATE '1997-01-01' AND score >= 60"""),
    "t7_unprocessed": (lambda t: u.unprocessed(t.tenders.select("tender_id", "status"), _predictions(t).filter("score >= 40"), "tender_id"), """
    SELECT tender_id, status FROM tenders, (SELECT 1) z WHERE (COALESCE(num_bidders, 0) * 17 + amendment_count * 29) % 101 < 40 AND (COALESCE(num_bidders, 0) * 17 + amendment_count * 29 + 13) % 101 < 40"""),
    "g9_weak_labels": (lambda t: u.weak_labels(g.pair_features(t.bidders).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("bid_likeness") * 170).alias("confidence"))), """
    , p AS (SELECT a.company_name AS x, b.company_name AS y, ROUND(AVG(1 - ABS(a.bid_amount_mkd - b.bid_amount_mkd) / NULLIF(GREATEST(a.bid_amount_mkd, b.bid_amount_mkd), 0)), 6) * 170 AS c FROM bidders a JOIN bidders b ON a.tender_id = b.tender_id AND a.company_name < b.company_name GROUP BY 1, 2)
    SELECT x AS company, 1 AS label FROM p WHERE c >= 70 UNION SELECT y, 1 FROM p WHERE c >= 70"""),
    "g13_direct_connections": (lambda t: u.direct_connections(_trade(t)), f"""
    , tr AS ({_TRADE}), w AS (SELECT src AS node, dst AS other, weight, 1 AS way FROM tr UNION ALL SELECT dst, src, weight, 2 FROM tr)
    SELECT node, other, ['out', 'in', 'both'][bit_or(way)] AS direction, SUM(weight) AS weight FROM w GROUP BY 1, 2"""),
    "g25_merged_clusters": (lambda t: u.merged_clusters(_clusters(t)), _CLUSTERS + " SELECT cluster, member FROM merged"),
    "g26_cluster_tenders": (lambda t: u.cluster_tenders(u.merged_clusters(_clusters(t)), t.bidders, t.tenders), _CLUSTERS + """
    SELECT cluster, COUNT(*) AS tenders, SUM(estimated_value_mkd) AS value, COUNT(DISTINCT procuring_entity) AS buyers, COUNT(*) FILTER (WHERE won) AS won
    FROM (SELECT cluster, tender_id, bool_or(is_winner) AS won FROM bidders JOIN merged ON member = company_name GROUP BY 1, 2 HAVING COUNT(*) >= 2) p JOIN tenders USING (tender_id) GROUP BY 1"""),
    "x2_packed_sentences": (lambda t: v.packed_sentences(t.raw("documents")), r"""
    , s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS l FROM documents) z),
    n AS (SELECT doc_id, pos, len(regexp_extract_all(sentence, '\S+')) AS words FROM s WHERE len(regexp_extract_all(sentence, '\S+')) > 0),
    r AS (SELECT *, COALESCE(SUM(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 128 AS raw FROM n),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY raw) AS chunk, row_number() OVER (PARTITION BY doc_id, raw ORDER BY pos DESC) AS e FROM r),
    m AS (SELECT *, MAX(chunk) OVER (PARTITION BY doc_id) AS last FROM c)
    SELECT doc_id, CAST(k AS INTEGER) AS chunk, COUNT(*) AS sentences, SUM(words) AS words FROM (SELECT doc_id, words, chunk AS k FROM m UNION ALL SELECT doc_id, words, chunk + 1 FROM m WHERE e <= 2 AND chunk < last) u GROUP BY 1, 2"""),
    "x6_weighted_rank": (lambda t: t.tenders.select("tender_id", F.round(x.weighted_rank([(F.col("title"), 1.0), (F.col("category"), 0.4), (F.col("procuring_entity"), 0.2)], QUERY.split()), 6).alias("rank")).filter("rank > 0"), f"""
    SELECT tender_id, rank FROM (SELECT tender_id, ROUND({_rank("title", 1.0)} + {_rank("category", 0.4)} + {_rank("procuring_entity", 0.2)}, 6) AS rank FROM tenders) z WHERE rank > 0"""),
    "x7_relevance": (lambda t: t.tenders.select("tender_id", F.round(v.relevance(F.col("title"), F.col("category"), QUERY), 6).alias("relevance")).filter("relevance > 0.3"), f"""
    SELECT tender_id, relevance FROM (SELECT tender_id, ROUND(GREATEST(2 * {_likeness("title")} + {_likeness("category")}, CASE WHEN contains(lower(title), '{QUERY}') THEN 1.5{D} ELSE 0 END, CASE WHEN contains(lower(category), '{QUERY}') THEN 0.8{D} ELSE 0 END), 6) AS relevance
                                      FROM tenders) z WHERE relevance > 0.3"""),
    "x14_sections": (lambda t: v.meaningful_sections(t.raw("documents")), r"""
    SELECT doc_id, len(l) AS sections, COALESCE(list_sum([length(z) for z in l]), 0) AS characters
    FROM (SELECT doc_id, [z for z in string_split(COALESCE(text, ''), chr(10)) if length(z) >= 50 and length(regexp_replace(z, '[^\p{L}]', '', 'g')) / length(z) >= 0.3] AS l FROM documents) q"""),
    "x16_settled_entities": (lambda t: v.settled_entities(t.raw("documents")), f"""
    SELECT doc_id, normalized, arg_min(entity_type, rk) AS entity_type
    FROM (SELECT doc_id, upper(regexp_replace(entity, '[^A-Za-z0-9@.]', '', 'g')) AS normalized, entity_type, list_position({list(x.ENTITIES)}, entity_type) AS rk FROM {_ENTITIES} e) z GROUP BY 1, 2"""),
    "x15_entity_mentions": (lambda t: x.extract_entities(t.raw("documents")), f"SELECT doc_id, entity_type, entity FROM {_ENTITIES} e"),
    "x22_completeness": (lambda t: v.completeness(t.tenders, _kinds(t), _required(t)), _DOCS + """
    , k AS (SELECT DISTINCT tender_id, CASE WHEN length(COALESCE(text, '')) < 300 THEN 'short' WHEN length(COALESCE(text, '')) < 1000 THEN 'medium' ELSE 'long' END AS kind FROM dt),
    q AS (SELECT * FROM (VALUES ('Open', 'short'), ('Open', 'long'), ('SimplifiedOpenProcedure', 'long'), ('QualificationSystem', 'short'), ('QualificationSystem', 'medium'), ('QualificationSystem', 'long')) v(procedure_type, kind))
    SELECT t.tender_id, COUNT(k.kind) AS present, COUNT(*) AS needed, ROUND(COUNT(k.kind) / COUNT(*), 6) AS share FROM tenders t JOIN q ON q.procedure_type = t.procedure_type LEFT JOIN k ON k.tender_id = t.tender_id AND k.kind = q.kind GROUP BY 1"""),
    "x23_timing_anomalies": (lambda t: v.timing_anomalies(_uploads(t)), _DOCS + """
    , up AS (SELECT tender_id, COALESCE(text, '') AS text, closing_date + CAST(doc_id % 5 - 3 AS INTEGER) AS uploaded, closing_date FROM dt JOIN tenders USING (tender_id)),
    da AS (SELECT tender_id, uploaded, COUNT(*) AS n, COUNT(*) FILTER (WHERE uploaded > closing_date) AS late FROM up GROUP BY 1, 2)
    SELECT tender_id, late, crowded_days, repeated FROM (SELECT tender_id, SUM(late) AS late, COUNT(*) FILTER (WHERE n >= 3) AS crowded_days FROM da GROUP BY 1) a JOIN (SELECT tender_id, COUNT(*) - COUNT(DISTINCT text) AS repeated FROM up GROUP BY 1) b USING (tender_id)"""),
    "x28_inferred_codes": (lambda t: v.inferred_codes(t.raw("documents"), CODES), ", p AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{code}' AS code, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {n} ELSE 0 END" for w, n in words.items()) + " AS score FROM documents" for code, words in CODES.items()) + """)
    SELECT doc_id, arg_max(code, (score, code)) AS code, CAST(MAX(score) AS INTEGER) AS score FROM p GROUP BY 1 HAVING MAX(score) > 0"""),
    "x29_result_quality": (lambda t: t.raw("documents").select("doc_id", v.result_quality(F.col("text")).alias("quality")), ", q AS (SELECT doc_id, COALESCE(text, '') AS t, "
        + " + ".join(f"CASE WHEN contains(COALESCE(text, ''), '{p}') THEN 1 ELSE 0 END" for p in v.BAD_SIGNS) + " AS bad, "
        + " + ".join(f"CASE WHEN regexp_matches(COALESCE(text, ''), '{p}') THEN 1 ELSE 0 END" for p in v.GOOD_SIGNS) + f""" AS good, COALESCE(TRY_CAST(regexp_extract(COALESCE(text, ''), '{v.HITS}', 1) AS DOUBLE), 0) AS hits FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE ROUND(LEAST(1, GREATEST(0, 0.5{D} - LEAST(0.4{D}, bad * 0.15{D}) + LEAST(0.5{D}, good * 0.1{D}) + CASE WHEN bad = 0 THEN CASE WHEN length(t) > 500 THEN 0.1{D} ELSE 0 END + CASE WHEN length(t) > 1500 THEN 0.1{D} ELSE 0 END ELSE 0 END
      + CASE WHEN hits >= 3 THEN 0.1{D} ELSE 0 END + CASE WHEN hits >= 5 THEN 0.1{D} ELSE 0 END)), 6) END AS quality FROM q"""),
    "t3_change_stream": (lambda t: s.change_stream(s.read_events(t.spark, t.sf_dir).select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "change"), """
    SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'new' WHEN p <> event_type THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) z"""),
    "t6_weekly_digest": (lambda t: s.drain(s.weekly_digest(s.read_events(t.spark, t.sf_dir)), mode="complete"), """
    SELECT CAST(date_trunc('week', ts) AS DATE) AS day, user_id, COUNT(*) AS events, ROUND(SUM(value), 4) AS value, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2"""),
    "t6_daily_digest": (lambda t: s.drain(s.daily_digest(s.read_events(t.spark, t.sf_dir)), mode="complete"), """
    SELECT CAST(ts AS DATE) AS day, user_id, COUNT(*) AS events, ROUND(SUM(value), 4) AS value, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
_RECURSIVE = DOMAIN_SQL.replace("WITH bids0", "WITH RECURSIVE bids0", 1)
ORACLES = {name: (_RECURSIVE if name[:3] in ("g25", "g26") else "" if "WITH" in sql.lstrip()[:6] or "WITH bids0" in sql or name.startswith(("r14", "r15", "r17")) else DOMAIN_SQL) + sql for name, (_, sql) in _ALL.items()}
