"""Registered queries: release import, uncertainty, review, evaluation, temporal profiles, further text measures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bidscope.functions import text as x
from bidscope.operators import assessment as a
from bidscope.operators import history as h
from bidscope.operators import detectors as d
from bidscope.operators import risk as r
from bidscope.plans.detector_queries import CRI_SQL, FLAGS_SQL, flag_tables
from bidscope.sources import ocds
from bidscope.sources.domain import DOMAIN_SQL
from bidscope.workspace import fresh_path

D = "::DOUBLE"
AW = "status IN ('awarded', 'completed')"


def _releases(t):
    """Orders written as release JSON and read back through the import schema."""
    path = fresh_path(t.spark, "releases")
    ocds.from_orders(t.raw("orders"), t.raw("lineitem")).write.text(path)
    return ocds.read_releases(t.spark, path)


def _scored(t):
    """The index as a score, an overrun of the estimate as what it should have told."""
    own, flags = flag_tables(t)
    label = (F.col("actual_value_mkd") > 2 * F.col("estimated_value_mkd")).cast("int")
    return own.tenders.filter("actual_value_mkd is not null").join(d.risk_index(flags), "tender_id").select("tender_id", (F.col("cri") / 100.0).alias("score"), label.alias("label"))


_SCORED = FLAGS_SQL + "," + CRI_SQL + ", sc AS (SELECT t.tender_id, cri / 100.0::DOUBLE AS score, CASE WHEN actual_value_mkd > 2 * estimated_value_mkd THEN 1 ELSE 0 END AS label FROM tenders t JOIN cri ON cri.tender_id = t.tender_id WHERE actual_value_mkd IS NOT NULL) "


def _profile(t):
    own, flags = flag_tables(t)
    return a.temporal_profile(own.tenders, flags, date(2001, 1, 1))


def _queue(t):
    own, flags = flag_tables(t)
    score = (F.coalesce("num_bidders", F.lit(0)) * 17 + F.col("amendment_count") * 29) % 101
    return a.review_queue(flags, own.tenders.select("tender_id", score.alias("score")))


def _calibrated(t):
    own, flags = flag_tables(t)
    verdicts = own.tenders.select("tender_id", F.coalesce(F.col("actual_value_mkd") > 2 * F.col("estimated_value_mkd"), F.lit(False)).cast("int").alias("fraud"))
    found = a.calibrated_weights(flags, verdicts) or d.WEIGHTS
    return t.spark.createDataFrame(list(found.items()), "flag_type string, weight double").join(r.flag_type_counts(flags), "flag_type")


def _interests(t):
    n = t.raw("embeddings").count()
    events = t.raw("events").withColumn("item_id", F.col("event_id") % n)
    return x.interest_vectors(events, t.raw("embeddings"))


def _context(t):
    return x.context_window(t.raw("conversations").select(F.col("conv_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("passage"), (F.lit(1.0) / (F.col("turn") + 1)).alias("similarity")), budget=400).select("query_id", "place", F.sha2(F.col("passage").cast("binary"), 256).alias("passage"))


_ALL = {
    "s1_ocds_tenders": (lambda t: ocds.tenders(_releases(t)).select("ocid", "title", "procuring_entity", "estimated_value_mkd", "actual_value_mkd", "winner", "publication_date"), f"""
      SELECT 'ocds-70d2nz-00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS ocid, o_orderpriority AS title, 'Buyer ' || o_custkey AS procuring_entity, o_totalprice * CASE WHEN o_orderkey % 2 = 1 THEN 61.5{D} ELSE 1.0{D} END AS estimated_value_mkd,
      MAX(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * CASE WHEN l_linenumber % 2 = 1 THEN 61.5{D} ELSE 1.0{D} END END) AS actual_value_mkd, 'S' || MIN(CASE WHEN l_returnflag = 'A' THEN (l_linenumber, l_suppkey) END)[2] AS winner, CAST(o_orderdate AS DATE) AS publication_date
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_custkey, o_totalprice, o_orderdate"""),
    "s1_ocds_bidders": (lambda t: ocds.bidders(_releases(t)).groupBy("company_name").agg(F.count(F.lit(1)).alias("bids"), F.count_if("is_winner").alias("wins")), """
      SELECT company_name, COUNT(*) AS bids, SUM(CASE WHEN w THEN 1 ELSE 0 END) AS wins FROM (SELECT 'S' || l_suppkey AS company_name, bool_or(l_returnflag = 'A') OVER (PARTITION BY l_orderkey, l_suppkey) AS w, l_orderkey, l_returnflag FROM lineitem) x WHERE l_orderkey % 3 <> 0 OR l_returnflag = 'A' GROUP BY 1"""),
    "s10_json_profile": (lambda t: ocds.json_profile(t.raw("events"), "props"), None),
    "r8_bootstrap_intervals": (lambda t: a.bootstrap_interval(flag_tables(t)[1]), None),
    "r9_feature_completeness": (lambda t: a.completeness(r.tender_features(t.tenders, t.bidders)), None),
    "r10_review_queue": (_queue, FLAGS_SQL + "," + CRI_SQL + f""", ml AS (SELECT tender_id, (COALESCE(num_bidders, 0) * 17 + amendment_count * 29) % 101 AS score FROM tenders),
      cb AS (SELECT tender_id, string_agg(DISTINCT flag_type, ',' ORDER BY flag_type) AS combo, COUNT(*) AS flags FROM flags GROUP BY 1), fr AS (SELECT tender_id, COUNT(*) OVER (PARTITION BY combo) AS n FROM cb),
      ed AS (SELECT c.tender_id, 1 AS rule, 'boundary' AS reason, ROUND(1 / (1{D} + ABS(cri - 50)), 6) AS priority FROM cri c JOIN cb USING (tender_id) WHERE ABS(cri - 50) <= 15 ORDER BY ABS(cri - 50), flags DESC, tender_id LIMIT 25),
      sp AS (SELECT tender_id, 2, 'disagreement', ROUND(ABS(cri - score) / 100{D}, 6) FROM cri JOIN ml USING (tender_id) WHERE ABS(cri - score) > 20 ORDER BY ABS(cri - score) DESC, tender_id LIMIT 15),
      od AS (SELECT tender_id, 3, 'novel', ROUND(1{D} / n, 6) FROM fr WHERE n <= 3 ORDER BY n, tender_id LIMIT 10)
      SELECT tender_id, arg_min(reason, rule) AS reason, arg_min(priority, rule) AS priority FROM (SELECT * FROM ed UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM od) x GROUP BY 1"""),
    "r11_calibrated_weights": (_calibrated, None),
    "m10_balanced_labels": (lambda t: (lambda own, flags: a.balanced_labels(flags.filter("severity = 'critical'"), own.tenders).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))(*flag_tables(t)), None),
    "m4_relationship_features": (lambda t: h.relationship_features(t.tenders, t.bidders), DOMAIN_SQL + """, j AS (
        SELECT t.tender_id, t.procuring_entity AS buyer, t.winner, t.publication_date AS day, t.num_bidders, b.company_name FROM tenders t LEFT JOIN bidders b ON b.tender_id = t.tender_id WHERE t.status IN ('awarded', 'closed')),
      pair AS (SELECT t.tender_id, COUNT(*) FILTER (WHERE j.winner = t.winner) AS pw, COUNT(*) FILTER (WHERE j.company_name = t.winner) AS pb, COUNT(*) AS rows FROM tenders t JOIN j ON j.buyer = t.procuring_entity AND j.day < t.publication_date GROUP BY 1),
      comp AS (SELECT company, day, SUM(w) AS w, SUM(b) AS b FROM (SELECT winner AS company, day, 1 AS w, 0 AS b FROM j WHERE winner IS NOT NULL UNION ALL SELECT company_name, day, 0, 1 FROM j WHERE company_name IS NOT NULL) x GROUP BY 1, 2),
      total AS (SELECT t.tender_id, SUM(w) AS tw, SUM(b) AS tb FROM tenders t JOIN comp ON company = t.winner AND comp.day < t.publication_date GROUP BY 1),
      fi AS (SELECT winner AS company, buyer, MIN(day) AS day FROM j WHERE winner IS NOT NULL GROUP BY 1, 2),
      inst AS (SELECT t.tender_id, COUNT(*) AS n FROM tenders t JOIN fi ON company = t.winner AND fi.day < t.publication_date GROUP BY 1),
      own AS (SELECT t.tender_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE p.num_bidders = 1) AS s, AVG(p.num_bidders) AS m FROM tenders t JOIN tenders p ON p.procuring_entity = t.procuring_entity AND p.publication_date < t.publication_date AND p.status IN ('awarded', 'closed') AND p.num_bidders > 0 GROUP BY 1)
      SELECT t.tender_id, CASE WHEN winner IS NULL THEN 0 ELSE COALESCE(pw, 0) END AS pair_wins, CASE WHEN winner IS NULL THEN 0 ELSE COALESCE(pb, 0) END AS pair_bids, CASE WHEN winner IS NULL OR COALESCE(pb, 0) = 0 THEN 0 ELSE ROUND(pw / pb, 6) END AS pair_win_rate,
             CASE WHEN winner IS NULL OR rows IS NULL THEN 0 ELSE ROUND(pw / rows, 6) END AS market_share, COALESCE(tw, 0) AS total_wins, COALESCE(tb, 0) AS total_bids, CASE WHEN COALESCE(tb, 0) = 0 THEN 0 ELSE ROUND(tw / tb, 6) END AS win_rate,
             COALESCE(inst.n, 0) AS institutions, CAST(winner IS NOT NULL AND COALESCE(tb, 0) <= 1 AS INTEGER) AS new_supplier, CAST(winner IS NOT NULL AND COALESCE(tb, 0) >= 10 AS INTEGER) AS experienced,
             COALESCE(own.n, 0) AS buyer_tenders, COALESCE(ROUND(s / own.n, 6), 0) AS buyer_single_rate, COALESCE(ROUND(m, 6), 0) AS buyer_mean_bidders
      FROM tenders t LEFT JOIN pair ON pair.tender_id = t.tender_id LEFT JOIN total ON total.tender_id = t.tender_id LEFT JOIN inst ON inst.tender_id = t.tender_id LEFT JOIN own ON own.tender_id = t.tender_id"""),
    "m25_trajectories": (lambda t: h.trajectories(_profile(t)), None),
    "m14_threshold_sweep": (lambda t: a.threshold_sweep(_scored(t)), _SCORED + f", b AS (SELECT LEAST(20, CAST(FLOOR(score * 20) AS INTEGER)) AS bin, SUM(label) AS pos, COUNT(*) AS n FROM sc GROUP BY 1), c AS (SELECT bin, SUM(pos) OVER (ORDER BY bin DESC) AS tp, SUM(n) OVER (ORDER BY bin DESC) AS fl, SUM(pos) OVER () AS ap FROM b) SELECT bin / 20{D} AS threshold, ROUND(tp / fl, 6) AS precision, ROUND(tp / NULLIF(ap, 0), 6) AS recall, ROUND(2 * (tp / fl) * (tp / NULLIF(ap, 0)) / NULLIF(tp / fl + tp / NULLIF(ap, 0), 0), 6) AS f1 FROM c"),
    "m18_calibration": (lambda t: a.calibration(_scored(t)), _SCORED + "SELECT bin, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, ROUND(AVG(label), 6) AS share, ROUND(ABS(AVG(score) - AVG(label)), 6) AS gap FROM (SELECT *, LEAST(9, CAST(FLOOR(score * 10) AS INTEGER)) AS bin FROM sc) x GROUP BY bin"),
    "m23_temporal_profile": (_profile, FLAGS_SQL + "," + CRI_SQL + f""", b AS (SELECT procuring_entity, publication_date, COALESCE(cri, 0) AS cri, DATE '2001-01-01' - publication_date AS age, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date DESC, t.tender_id DESC) AS back FROM tenders t LEFT JOIN cri ON cri.tender_id = t.tender_id),
      p AS (SELECT procuring_entity, COUNT(*) AS tenders, ROUND(AVG(CASE WHEN age BETWEEN 0 AND 30 THEN cri END), 6) AS mean_30d, ROUND(AVG(CASE WHEN age BETWEEN 0 AND 90 THEN cri END), 6) AS mean_90d, ROUND(AVG(CASE WHEN age BETWEEN 0 AND 365 THEN cri END), 6) AS mean_365d, ROUND(regr_slope(CASE WHEN back <= 20 THEN cri END, CASE WHEN back <= 20 THEN -back END), 6) AS slope,
      ROUND(stddev_pop(CASE WHEN back <= 20 THEN cri END), 6) AS volatility, MIN(CASE WHEN cri > 0 THEN age END) AS days_since_flag, ROUND(COUNT(*) / (GREATEST(MAX(publication_date) - MIN(publication_date), 1) / 30.0{D}), 6) AS pace FROM b GROUP BY 1 HAVING COUNT(*) >= 5)
      SELECT *, CASE WHEN slope > 1 THEN 'escalating' WHEN slope < -1 THEN 'improving' WHEN volatility > 20 THEN 'volatile' ELSE 'stable' END AS trajectory FROM p"""),
    "x8_context_windows": (_context, f"""SELECT query_id, place, sha256(passage) AS passage FROM (SELECT *, SUM(CAST(CEIL(length(passage) / 4{D}) AS BIGINT)) OVER w AS used, row_number() OVER w AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, left(passage, 100) ORDER BY s DESC, passage) AS n FROM (SELECT conv_id AS query_id, COALESCE(text, '') AS passage, 1.0{D} / (turn + 1) AS s FROM conversations) c) d WHERE n = 1
      WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, passage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) e WHERE used <= 400"""),
    "x13_copied_share": (lambda t: x.copied_share(t.raw("documents")), r"""
      WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
      g AS (SELECT doc_id, unnest(list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, GREATEST(len(w) - 4, 1) + 1)])) AS g FROM w),
      c AS (SELECT g, COUNT(*) AS n FROM g GROUP BY 1)
      SELECT doc_id, copied FROM (SELECT doc_id, ROUND(COUNT(*) FILTER (WHERE n > 1) / COUNT(*), 6) AS copied FROM g JOIN c USING (g) GROUP BY 1) z WHERE copied >= 0.6"""),
    "x27_interest_vectors": (_interests, f"""SELECT user_id, place, ROUND(SUM(v * w) / SUM(w), 6) AS value FROM (SELECT user_id, w, unnest(embedding::DOUBLE[]) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place FROM (SELECT user_id, event_id % (SELECT COUNT(*) FROM embeddings) AS item, CASE event_type WHEN 'view' THEN 1.0{D} WHEN 'click' THEN 1.5{D} WHEN 'signup' THEN 2.0{D} WHEN 'purchase' THEN 2.5{D} END AS w,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')) q JOIN embeddings ON vec_id = item WHERE n <= 100) u GROUP BY 1, 2"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
ORACLES["m25_trajectories"] = f"""
WITH p AS (SELECT procuring_entity, COALESCE(slope, 0) AS s, COALESCE(volatility, 0) AS v, COALESCE(mean_30d, 0) AS m, COALESCE(mean_90d, 0) AS q, COALESCE(mean_365d, 0) AS y FROM ({ORACLES["m23_temporal_profile"]}) z),
c AS (SELECT *, CASE WHEN s > 0.5 AND m > y THEN 'escalating' WHEN v > 20 THEN 'volatile' WHEN q > 60 AND v < 10 THEN 'stable_high' WHEN s < -0.5 THEN 'declining' WHEN q < 30 AND v < 10 THEN 'stable_low' ELSE 'moderate' END AS trajectory FROM p)
SELECT procuring_entity, trajectory, ROUND(CASE trajectory WHEN 'escalating' THEN LEAST(0.95{D}, 0.5{D} + ABS(s) / 5 + (m - y) / 100) WHEN 'volatile' THEN LEAST(0.85{D}, 0.4{D} + v / 50) WHEN 'stable_high' THEN LEAST(0.9{D}, 0.6{D} + q / 200)
       WHEN 'declining' THEN LEAST(0.9{D}, 0.5{D} + ABS(s) / 5) WHEN 'stable_low' THEN LEAST(0.9{D}, 0.7{D} + (30 - q) / 100) ELSE 0.5{D} END, 3) AS confidence FROM c"""
