"""Registered queries: risk statistics, features, cleaning, text, vectors, entity joins, query idioms and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidscope.functions import cleaning as c
from bidscope.functions import text as x
from bidscope.operators import entities as e
from bidscope.operators import risk as r
from bidscope.plans.detector_queries import CRI_SQL, FLAGS_SQL, flag_tables
from bidscope.sources.domain import AS_OF, DOMAIN_SQL
from bidscope.streaming import incremental as s

D = "::DOUBLE"
AW = "status IN ('awarded', 'completed')"
WON = f"{AW} AND winner IS NOT NULL"


def row_count():
    return F.count(F.lit(1))


def _with_flags(f):
    def run(t):
        own, flags = flag_tables(t)
        return f(flags, own)

    return run


_DATED = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'soon' END"


def _dates(t):
    """Order dates as texts in several formats and with month names, read back."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    month = F.element_at(F.array(*[F.lit(m) for m in c.MONTHS]), F.month(d))
    text = F.when(k == 0, F.date_format(d, "dd.MM.yyyy")).when(k == 1, F.concat(F.date_format(d, "dd"), F.lit(" "), month, F.lit(" "), F.date_format(d, "yyyy"))).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "dd/MM/yyyy")).otherwise("soon")
    return t.raw("orders").select("o_orderkey", c.parse_date(text, AS_OF, 1993, 1997).alias("parsed"))


def _amounts(t):
    """Prices as texts with European or American separators, read back."""
    p = F.col("l_extendedprice")
    us = F.format_number(p, 2)
    eu = F.translate(us, ",.", ".,")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(eu, F.lit(" MKD"))).otherwise(F.concat(F.lit("from "), us, F.lit(" to 9")))
    return t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(c.parse_amount(text)).alias("amount"))


def _hashed(t, changed: bool):
    v = F.col("estimated_value_mkd") + (F.when(F.substring("tender_id", -1, 1) == "7", 1).otherwise(0) if changed else 0)
    rows = t.tenders.filter(F.substring("tender_id", -1, 1) != ("3" if changed else "5")).select("tender_id", c.content_hash({"title": F.col("title"), "value": v.cast("long"), "status": F.col("status"), "winner": F.col("winner")}).alias("content_hash"))
    return rows if changed else rows.withColumn("scrape_count", F.lit(1))


def _changes(t):
    return c.classify_changes(_hashed(t, False), _hashed(t, True)).groupBy("change").agg(row_count().alias("tenders"), F.sum("scrape_count").alias("scrapes"))


def _psi(t):
    split = date(1998, 1, 1)
    return r.psi(t.tenders.filter(F.col("publication_date") < F.lit(split)), t.tenders.filter(F.col("publication_date") >= F.lit(split)), "estimated_value_mkd")


def _subscriptions(t):
    """One saved search per market segment and nation: the buyers' own."""
    n = t.raw("nation")
    return n.select(F.col("n_nationkey").cast("long").alias("alert_id"), F.element_at(F.array(F.lit("plate"), F.lit("gear"), F.lit("bolt")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("keyword"), F.concat(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("00")).alias("cpv4"), F.concat("n_name", F.lit("|")).alias("buyer"), F.lit(1e6).alias("low"), F.lit(2e6).alias("high"))


def _link(t):
    t = t.written()  # the linkage reads them six times
    left = t.tenders.filter("status = 'awarded'").select(F.col("tender_id").alias("id"), "procuring_entity", "title", "publication_date", "estimated_value_mkd", "cpv_code")
    right = t.tenders.filter("status = 'closed'").select(F.col("tender_id").alias("id"), "procuring_entity", "title", "publication_date", "estimated_value_mkd", "cpv_code")
    return e.link_tenders(left, right)


def _accounts(t):
    """Customers with short names at domains of a few dozen accounts, some of them under an alias."""
    k = F.col("c_custkey")
    base = F.concat(F.char((97 + k * 7 % 23).cast("int")), F.lit("li"), F.char((97 + k % 5).cast("int")), F.when(k % 4 == 0, (k % 50).cast("string")).otherwise(""))
    return t.raw("customer").select(k.alias("id"), F.concat(base, F.when(k % 3 == 0, "+news").otherwise(""), F.lit("@"), F.lower("c_mktsegment"), F.floor(k / 60).cast("string"), F.lit(".com")).alias("email"))


def _model(t):
    """A forest trained on point-in-time features; per outcome the mean predicted probability."""
    own = t.written()
    features = r.tender_features(own.tenders, own.bidders).drop("actual_to_estimate")
    label = own.tenders.select("tender_id", F.coalesce((F.col("actual_value_mkd") > F.col("estimated_value_mkd")), F.lit(False)).cast("double").alias("label"))
    model, rows = r.train_risk_model(features.join(label, "tender_id"))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return scored.groupBy("label").agg(row_count().alias("tenders"), F.round(F.avg("p"), 4).alias("mean_probability"))


_STREAM_WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS events, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1, 2"

#: Names whose activity the registered query reports.
WATCHED = ("nation_3|building", "co-5")
R12_SQL = FLAGS_SQL + "," + CRI_SQL + """, o AS (SELECT t.procuring_entity, cri, row_number() OVER (PARTITION BY procuring_entity ORDER BY publication_date DESC NULLS LAST, t.tender_id) AS n FROM cri JOIN tenders t ON t.tender_id = cri.tender_id),
h AS (SELECT *, COUNT(*) OVER (PARTITION BY procuring_entity) AS al FROM o WHERE n <= 10),
m AS (SELECT procuring_entity, MAX(al) AS al, AVG(CASE WHEN n <= al // 2 THEN cri END) - AVG(CASE WHEN n > al // 2 THEN cri END) AS move, MAX(CASE WHEN n = al THEN cri END) - MAX(CASE WHEN n = 1 THEN cri END) AS delta FROM h GROUP BY 1),
pf AS (SELECT tender_id, COUNT(*) AS flags, bool_or(flag_type = 'single_bidder') AS single FROM flags GROUP BY 1),
j AS (
  SELECT t.tender_id, lower(t.procuring_entity) AS buyer, lower(winner) AS winner, COALESCE(cri, 0) AS cri, COALESCE(flags, 0) AS flags, single, COALESCE(NULLIF(actual_value_mkd, 0), estimated_value_mkd, 0) AS value, al >= 3 AND move > 5 AS rising, delta,
         CASE WHEN winner IS NOT NULL THEN COUNT(*) FILTER (WHERE status = 'awarded') OVER (PARTITION BY t.procuring_entity, winner) END AS rep
  FROM tenders t LEFT JOIN cri ON cri.tender_id = t.tender_id LEFT JOIN pf ON pf.tender_id = t.tender_id LEFT JOIN m ON m.procuring_entity = t.procuring_entity)
SELECT tender_id, 'high_risk_score' AS rule, CASE WHEN cri >= 90 THEN 'critical' WHEN cri >= 80 THEN 'high' ELSE 'medium' END AS severity FROM j WHERE cri >= 70
UNION ALL SELECT tender_id, 'single_bidder_high_value', CASE WHEN value >= 5e7 THEN 'critical' WHEN value >= 2e7 THEN 'high' ELSE 'medium' END FROM j WHERE single AND value >= 5e6
UNION ALL SELECT tender_id, 'multiple_flags', CASE WHEN flags >= 6 THEN 'critical' WHEN flags >= 5 THEN 'high' ELSE 'medium' END FROM j WHERE flags >= 3
UNION ALL SELECT tender_id, 'repeat_pattern', CASE WHEN rep >= 10 THEN 'critical' WHEN rep >= 6 THEN 'high' ELSE 'medium' END FROM j WHERE rep >= 3
UNION ALL SELECT tender_id, 'escalating_risk', CASE WHEN cri >= 80 AND delta >= 20 THEN 'critical' WHEN cri >= 60 OR delta >= 15 THEN 'high' ELSE 'medium' END FROM j WHERE rising"""
WATCHED_SQL = """
UNION ALL SELECT tender_id, 'watched_entity', CASE WHEN cri >= 70 THEN 'high' WHEN cri >= 40 THEN 'medium' ELSE 'low' END FROM j WHERE contains(buyer, 'nation_3|building') OR contains(winner, 'co-5')"""

_ALL = {
    "r2_flag_type_counts": (_with_flags(lambda f, t: r.flag_type_counts(f)), FLAGS_SQL + "SELECT k.flag_type, COUNT(f.tender_id) AS flags, SUM(CASE WHEN f.severity = 'critical' THEN 1 ELSE 0 END) AS critical FROM (VALUES " + ", ".join(f"('{k}')" for k in r.WEIGHTS) + ") k(flag_type) LEFT JOIN flags f ON f.flag_type = k.flag_type GROUP BY 1"),
    "r4_average_score": (_with_flags(lambda f, t: r.average_score(f)), FLAGS_SQL + "SELECT tender_id, risk_score, flag_count, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 20 THEN 'low' ELSE 'minimal' END AS risk_level FROM (SELECT tender_id, CAST(ROUND(AVG(score)) AS INTEGER) AS risk_score, COUNT(*) AS flag_count FROM flags GROUP BY tender_id) x"),
    "r6_institution_risk": (_with_flags(lambda f, t: r.institution_risk(f, t.tenders)), FLAGS_SQL + "," + CRI_SQL + f"SELECT procuring_entity, COUNT(*) AS tenders, COUNT(cri) AS flagged, ROUND(COUNT(cri) * 100.0{D} / COUNT(*), 4) AS flagged_share, ROUND(AVG(cri), 4) AS mean_cri, MAX(cri) AS max_cri FROM tenders t LEFT JOIN cri ON cri.tender_id = t.tender_id GROUP BY 1"),
    "r7_suspicious_companies": (_with_flags(lambda f, t: r.suspicious_companies(f, t.tenders)), FLAGS_SQL + "SELECT winner, COUNT(*) AS flags, COUNT(DISTINCT f.tender_id) AS tenders, ROUND(AVG(score), 4) AS mean_score, MAX(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst FROM flags f JOIN tenders t ON f.tender_id = t.tender_id WHERE winner IS NOT NULL GROUP BY winner HAVING COUNT(DISTINCT f.tender_id) >= 3"),
    "r12_alerts": (_with_flags(lambda f, t: r.alerts(f, t.tenders, WATCHED)), R12_SQL + WATCHED_SQL),
    "r16_alert_matches": (lambda t: r.match_alerts(t.tenders, _subscriptions(t)), DOMAIN_SQL + ", subs AS (SELECT n_nationkey AS alert_id, CASE n_nationkey % 3 WHEN 0 THEN 'plate' WHEN 1 THEN 'gear' ELSE 'bolt' END AS keyword, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '00' AS cpv4, n_name || '|' AS buyer FROM nation) SELECT tender_id, CAST(alert_id AS BIGINT) AS alert_id, CAST(p AS INTEGER) AS match_score FROM (SELECT tender_id, alert_id, CASE WHEN lower(concat_ws(' ', title, category)) LIKE '%' || keyword || '%' THEN 25 ELSE 0 END + CASE WHEN starts_with(cpv_code, cpv4) THEN 30 ELSE 0 END + CASE WHEN contains(procuring_entity, buyer) THEN 25 ELSE 0 END + CASE WHEN estimated_value_mkd BETWEEN 1e6 AND 2e6 THEN 20 ELSE 0 END AS p FROM tenders, subs) x WHERE p >= 25"),
    "r22_full_coverage": (_with_flags(lambda f, t: r.full_coverage_score(f, t.tenders)), FLAGS_SQL + f"SELECT t.tender_id, ROUND(CASE WHEN n IS NULL THEN CASE WHEN num_bidders = 1 THEN 25 WHEN num_bidders = 2 THEN 10 ELSE 5 END ELSE LEAST(100.0{D}, mean * (1 + 0.15{D} * (n - 1))) END, 4) AS score, COALESCE(n, 0) AS flags FROM tenders t LEFT JOIN (SELECT tender_id, AVG(score) AS mean, COUNT(*) AS n FROM flags GROUP BY 1) f ON f.tender_id = t.tender_id WHERE {AW}"),
    "m1_tender_features": (lambda t: r.tender_features(t.tenders, t.bidders), DOMAIN_SQL + f""", bs AS (SELECT tender_id, COUNT(*) AS n, SUM(CASE WHEN disqualified THEN 1 ELSE 0 END) AS dq, AVG(bid_amount_mkd) AS m, stddev_pop(bid_amount_mkd) AS sd, MIN(bid_amount_mkd) AS lo, MAX(bid_amount_mkd) AS hi, quantile_cont(bid_amount_mkd, 0.5) AS md FROM bidders GROUP BY tender_id)
      SELECT t.tender_id, COALESCE(n, 0) AS bids, dq / n AS disqualified_rate, ROUND(m, 4) AS mean_bid, ROUND(sd / NULLIF(m, 0), 9) AS bid_cov, (hi - lo) / NULLIF(lo, 0) AS bid_range, ROUND(md / NULLIF(estimated_value_mkd, 0), 9) AS median_to_estimate, actual_value_mkd / NULLIF(estimated_value_mkd, 0) AS actual_to_estimate,
      closing_date - publication_date AS days_open, isodow(publication_date) - 1 AS weekday, month(publication_date) AS month, COUNT(*) OVER b AS buyer_before, SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) OVER b0 - SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) OVER b1 AS buyer_awards_before, CASE WHEN winner IS NOT NULL THEN COALESCE(SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) OVER p0 - SUM(CASE WHEN {AW} THEN 1 ELSE 0 END) OVER p1, 0) END AS pair_wins_before,
      CASE WHEN procedure_type LIKE '%Negotiated%' THEN 1 ELSE 0 END AS negotiated, amendment_count FROM tenders t LEFT JOIN bs ON bs.tender_id = t.tender_id
      WINDOW b AS (PARTITION BY procuring_entity ORDER BY publication_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), b0 AS (PARTITION BY procuring_entity ORDER BY publication_date), b1 AS (PARTITION BY procuring_entity, publication_date), p0 AS (PARTITION BY procuring_entity, winner ORDER BY publication_date), p1 AS (PARTITION BY procuring_entity, winner, publication_date)"""),
    "m22_buyer_timeline": (lambda t: r.buyer_timeline(t.tenders), DOMAIN_SQL + f"SELECT procuring_entity, month, tenders, single_share, estimated, ROUND(mb, 6) AS mean_before, COALESCE(tenders > 2 * mb, FALSE) AS spike FROM (SELECT *, AVG(tenders) OVER (PARTITION BY procuring_entity ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb FROM (SELECT procuring_entity, CAST(date_trunc('month', publication_date) AS DATE) AS month, COUNT(*) AS tenders, ROUND(SUM(CASE WHEN num_bidders = 1 THEN 1 ELSE 0 END) * 100.0{D} / COUNT(*), 6) AS single_share, SUM(estimated_value_mkd) AS estimated FROM tenders GROUP BY 1, 2) x) y"),
    "m24_change_points": (lambda t: r.change_points(r.buyer_timeline(t.tenders), "procuring_entity", "month", "tenders", threshold=3.0), None),
    "m12_forest": (_model, None),
    "m19_value_drift": (_psi, DOMAIN_SQL + f""", q AS (SELECT unnest(quantile_disc(estimated_value_mkd, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM tenders WHERE publication_date < DATE '1998-01-01'),
      b AS (SELECT publication_date < DATE '1998-01-01' AS ref, (SELECT COUNT(*) FROM q WHERE t.estimated_value_mkd > cut) AS bin FROM tenders t WHERE estimated_value_mkd IS NOT NULL),
      f AS (SELECT bin, GREATEST(SUM(CASE WHEN ref THEN 1 ELSE 0 END) / SUM(SUM(CASE WHEN ref THEN 1 ELSE 0 END)) OVER (), 1e-6) AS ex, GREATEST(SUM(CASE WHEN ref THEN 0 ELSE 1 END) / SUM(SUM(CASE WHEN ref THEN 0 ELSE 1 END)) OVER (), 1e-6) AS ac FROM b GROUP BY bin) SELECT CAST(bin AS INTEGER) AS bin, ROUND(ex, 6) AS expected, ROUND(ac, 6) AS actual, ROUND((ac - ex) * ln(ac / ex), 6) AS psi FROM f"""),
    "c3_content_hash": (lambda t: _hashed(t, True), DOMAIN_SQL + "SELECT tender_id, sha256(concat_ws('|', 'title:' || title, 'value:' || CAST(CAST(estimated_value_mkd + CASE WHEN tender_id LIKE '%7' THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR), 'status:' || status, 'winner:' || winner)) AS content_hash FROM tenders WHERE tender_id NOT LIKE '%3'"),
    "c4_change_classes": (_changes, DOMAIN_SQL + "SELECT CASE WHEN tender_id LIKE '%5' THEN 'new' WHEN tender_id LIKE '%7' THEN 'updated' ELSE 'unchanged' END AS change, COUNT(*) AS tenders, SUM(CASE WHEN tender_id LIKE '%5' THEN 1 ELSE 2 END) AS scrapes FROM tenders WHERE tender_id NOT LIKE '%3' GROUP BY 1"),
    "c6_parse_dates": (_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 AND year(o_orderdate) BETWEEN 1993 AND 1997 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders"),
    "c7_parse_amounts": (_amounts, "SELECT l_orderkey, l_linenumber, MAX(ROUND(l_extendedprice, 2)) AS amount FROM lineitem GROUP BY 1, 2"),
    "c11_transliterate": (lambda t: t.raw("part").select("p_partkey", c.transliterate(F.col("p_name")).alias("cyrillic")), "SELECT p_partkey, translate(" + "".join("replace(" for _ in c.DIGRAPHS) + "lower(p_name)" + "".join(f", '{a}', '{b}')" for a, b in c.DIGRAPHS) + f", '{c.LATIN}', '{c.CYRILLIC}') AS cyrillic FROM part"),
    "c13_company_names": (lambda t: t.raw("supplier").select("s_suppkey", c.normalized_company(F.concat("s_name", F.lit(" (doo), Ltd."))).alias("name")), "SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(s_name || ' (doo), Ltd.'), '[.,()#-]', ' ', 'g'), '\\b(DOO|LTD)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM supplier"),
    "c16_cpv_hierarchy": (lambda t: t.tenders.filter("cpv_code is not null").groupBy(c.cpv_level(F.col("cpv_code")).alias("level"), c.cpv_parent(F.col("cpv_code")).alias("parent")).agg(row_count().alias("tenders")), DOMAIN_SQL + "SELECT CASE WHEN length(rtrim(cpv_code, '0')) <= 2 THEN 'division' WHEN length(rtrim(cpv_code, '0')) = 3 THEN 'group' WHEN length(rtrim(cpv_code, '0')) = 4 THEN 'class' ELSE 'category' END AS level, substr(cpv_code, 1, 2) || '000000' AS parent, COUNT(*) AS tenders FROM tenders WHERE cpv_code IS NOT NULL GROUP BY 1, 2"),
    "j10_linked_tenders": (_link, DOMAIN_SQL + """, n AS (
      SELECT *, regexp_replace(regexp_replace(trim(lower(title)), '\\s+', ' ', 'g'), '[.,;:!?()]', '', 'g') AS t FROM tenders),
    p AS (
      SELECT a.tender_id AS id, b.tender_id AS right_id, ABS(a.publication_date - b.publication_date) AS days,
             LEAST(a.estimated_value_mkd, b.estimated_value_mkd) / GREATEST(a.estimated_value_mkd, b.estimated_value_mkd) AS ratio, a.cpv_code AS c, b.cpv_code AS d, COALESCE(a.t, '') AS t, COALESCE(b.t, '') AS u,
             list_distinct(string_split(a.t, ' ')) AS w, list_distinct(string_split(b.t, ' ')) AS x
      FROM n a JOIN n b ON a.procuring_entity = b.procuring_entity WHERE a.status = 'awarded' AND b.status = 'closed'),
    scored AS (
      SELECT id, right_id, CAST(CASE WHEN t = u THEN 100 WHEN contains(t, u) OR contains(u, t) THEN 50 ELSE COALESCE(FLOOR(ROUND(len(list_intersect(w, x)) * 40 / GREATEST(len(w), len(x)), 9)), 0) END
             + CASE WHEN days <= 7 THEN 30 WHEN days <= 30 THEN 15 WHEN days <= 90 THEN 5 ELSE 0 END + CASE WHEN ratio > 0.95 THEN 20 WHEN ratio > 0.8 THEN 10 ELSE 0 END
             + CASE WHEN c = d THEN 15 WHEN substr(c, 1, 5) = substr(d, 1, 5) THEN 8 ELSE 0 END AS INTEGER) AS score FROM p)
    SELECT id, arg_max(right_id, (score, right_id)) AS right_id, MAX(score) AS score FROM scored WHERE score >= 80 GROUP BY id"""),
    "j14_duplicate_accounts": (lambda t: e.duplicate_accounts(_accounts(t)), """
    WITH a AS (
      SELECT c_custkey AS id, chr(CAST(97 + c_custkey * 7 % 23 AS INTEGER)) || 'li' || chr(CAST(97 + c_custkey % 5 AS INTEGER)) || CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 50 AS VARCHAR) ELSE '' END AS base,
             lower(c_mktsegment) || c_custkey // 60 || '.com' AS domain FROM customer),
    p AS (SELECT *, regexp_replace(base, '[0-9]', '', 'g') AS plain FROM a)
    SELECT id, MIN(id) OVER (PARTITION BY domain, base) AS base_class, COUNT(*) OVER (PARTITION BY domain, base) AS base_size, MIN(id) OVER (PARTITION BY domain, plain) AS plain_class,
           COUNT(*) OVER (PARTITION BY domain, plain) AS plain_size, (SELECT COUNT(*) FROM p y WHERE y.domain = x.domain AND y.plain <> x.plain AND levenshtein(x.base, y.base) <= 2) AS near
    FROM p x"""),
    "x3_cosine_top": (lambda t: x.cosine_top(t.raw("embeddings"), t.raw("embeddings").filter("vec_id % 100 = 0")), """
    SELECT query_id, vec_id, label, cosine
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place
          FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, ROUND(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine
                FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) c) r WHERE place <= 10"""),
    "x4_mean_vectors": (lambda t: x.mean_vectors(t.raw("embeddings")), "SELECT label, CAST(place - 1 AS INTEGER) AS place, ROUND(AVG(x), 6) AS mean, COUNT(*) AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) u GROUP BY 1, 2"),
    "x1_sentence_chunks": (lambda t: x.sentence_chunks(t.raw("documents")).groupBy("doc_id").agg(row_count().alias("chunks"), F.sum("words").alias("words")), None),
    "x15_entities": (lambda t: x.extract_entities(t.raw("documents")).groupBy("entity_type").agg(row_count().alias("mentions"), F.count_distinct("doc_id").alias("documents")), None),
    "x17_emails": (lambda t: x.extract_entities(t.raw("documents"), {"EMAIL": x.ENTITIES["EMAIL"]}), "SELECT doc_id, 'EMAIL' AS entity_type, entity FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '" + x.ENTITIES["EMAIL"] + "'))) AS entity FROM documents) u"),
    "x20_complexity": (lambda t: x.complexity(t.raw("documents")), r"""
      WITH d AS (
        SELECT doc_id, [z for z in string_split_regex(lower(COALESCE(text, '')), '[^\p{L}]+') if z <> ''] AS w, len([z for z in string_split_regex(COALESCE(text, ''), '[.!?]+') if length(trim(z)) > 0]) AS sentences FROM documents)
      SELECT doc_id, len(w) AS words, sentences, ROUND(list_sum([length(z) for z in w]) / NULLIF(len(w), 0), 6) AS mean_word, ROUND(len(w) / NULLIF(sentences, 0), 6) AS mean_sentence, ROUND(len(list_distinct(w)) / NULLIF(len(w), 0), 6) AS variety FROM d"""),
    "x26_duplicate_documents": (lambda t: x.duplicate_documents(t.raw("documents")), "SELECT doc_id, first_id, copies FROM (SELECT doc_id, MIN(doc_id) OVER w AS first_id, COUNT(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)) x WHERE copies > 1 AND doc_id <> first_id"),
    "w6_trailing_year": (lambda t: t.tenders.select("tender_id", row_count().over(Window.partitionBy("procuring_entity").orderBy(F.datediff("publication_date", F.lit(date(1970, 1, 1)))).rangeBetween(-365, -1)).alias("n")), DOMAIN_SQL + "SELECT tender_id, COUNT(*) OVER (PARTITION BY procuring_entity ORDER BY publication_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n FROM tenders"),
    "a6_ordered_arrays": (lambda t: t.bidders.groupBy("tender_id").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("bid_amount_mkd", "company_name"))), lambda v: v["company_name"]), 1, 3), ",").alias("lowest")), DOMAIN_SQL + "SELECT tender_id, string_agg(company_name, ',' ORDER BY bid_amount_mkd, company_name) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY bid_amount_mkd, company_name) AS n FROM bidders) x WHERE n <= 3 GROUP BY 1"),
    "a10_modal_category": (lambda t: t.tenders.filter("category is not null").groupBy("procuring_entity", "category").agg(row_count().alias("n")).groupBy("procuring_entity").agg(F.min(F.struct(-F.col("n"), "category"))["category"].alias("category")), DOMAIN_SQL + "SELECT procuring_entity, category FROM (SELECT procuring_entity, category, row_number() OVER (PARTITION BY procuring_entity ORDER BY COUNT(*) DESC, category) AS p FROM tenders WHERE category IS NOT NULL GROUP BY 1, 2) x WHERE p = 1"),
    "o7_three_source_winners": (lambda t: t.tenders.filter("winner is not null").select(F.col("winner").alias("name"), "actual_value_mkd").unionByName(t.bidders.filter("is_winner").select(F.col("company_name").alias("name"), F.col("bid_amount_mkd").alias("actual_value_mkd"))).unionByName(t.raw("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("actual_value_mkd"))).groupBy("name").agg(row_count().alias("n"), F.round(F.sum("actual_value_mkd"), 2).alias("value")), DOMAIN_SQL + "SELECT name, COUNT(*) AS n, ROUND(SUM(v), 2) AS value FROM (SELECT winner AS name, actual_value_mkd AS v FROM tenders WHERE winner IS NOT NULL UNION ALL SELECT company_name, bid_amount_mkd FROM bidders WHERE is_winner UNION ALL SELECT s_name, s_acctbal FROM supplier) u GROUP BY 1"),
    "p46_event_funnel": (lambda t: t.raw("events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "purchase")], F.round(F.sum("value"), 4).alias("value")), "SELECT user_id, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view, SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchase, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1"),
    "t5_hourly_counts": (lambda t: s.drain(s.windowed_counts(s.read_events(t.spark, t.sf_dir)), mode="complete"), _STREAM_WINDOWS),
    "t5_sessions": (lambda t: s.drain(s.sessions(s.read_events(t.spark, t.sf_dir)), mode="complete"), """
      WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT CAST(MIN(ts) AS TIMESTAMP) AS session_start, CAST(MAX(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS session_end, user_id, COUNT(*) AS events FROM n GROUP BY user_id, k"""),
    "t2_unique_alerts": (lambda t: s.drain(s.unique_alerts(s.read_events(t.spark, t.sf_dir), ["user_id", "event_type"], watermark="100 days")).groupBy("event_type").agg(row_count().alias("users")), "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1"),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
