"""Registered queries: whole feature sets, document risk, cached reports, clusters and monthly series of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidscope.functions.text import table_rows_to_items
from bidscope.operators import cases as c
from bidscope.operators import documents as dc
from bidscope.operators import feature_sets as fs
from bidscope.operators import follow_up as u
from bidscope.plans.detector_queries import FLAGS_SQL, flag_tables
from bidscope.plans.follow_queries import _CLUSTERS, _clusters
from bidscope.sources import dimension_cache as dim
from bidscope.sources.domain import DOMAIN_SQL
from bidscope.workspace import fresh_path, materialize

D = "::DOUBLE"


def _files(t) -> DataFrame:
    """Documents as files of tenders: a size, pages and a state of their own."""
    k = F.col("doc_id")
    n = t.raw("orders").count()
    size = F.when(k % 19 == 0, 0).when(k % 23 == 0, 1024 * 1024 + k % 50).when(k % 7 == 0, 12_000).otherwise(F.col("n_chars") * 3)
    state = F.when(k % 5 == 0, "failed").when(k % 11 == 0, "pending").otherwise("success")
    return t.raw("documents").select(
        F.concat(F.lit("T"), (F.floor(k / 4) % n).cast("string")).alias("tender_id"), "doc_id", F.concat(F.lit("f"), (k % 3).cast("string")).alias("file_name"), size.cast("long").alias("file_size_bytes"), state.alias("extraction_status"),
        (k % 40).alias("page_count"), "text",
    )


_FILES_SQL = """files AS MATERIALIZED (SELECT 'T' || CAST((doc_id // 4) % (SELECT COUNT(*) FROM orders) AS VARCHAR) AS tender_id, doc_id, 'f' || (doc_id % 3) AS file_name,
  CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 23 = 0 THEN 1048576 + doc_id % 50 WHEN doc_id % 7 = 0 THEN 12000 ELSE n_chars * 3 END AS sz, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'success' END AS st, doc_id % 40 AS pages, length(COALESCE(text, '')) AS n FROM documents),
odd AS MATERIALIZED (
  SELECT tender_id, 'empty_file' AS kind, CASE WHEN sz = 0 THEN 'high' ELSE 'medium' END AS severity, doc_id, CAST(sz AS VARCHAR) AS detail FROM files WHERE sz < 1024
  UNION ALL SELECT tender_id, 'size_anomaly', 'medium', NULL, COUNT(*) || ' x ' || sz FROM files WHERE sz > 1024 GROUP BY tender_id, sz HAVING COUNT(DISTINCT file_name) >= 2
  UNION ALL SELECT tender_id, 'size_anomaly', 'low', doc_id, CAST(r AS VARCHAR) FROM files, (VALUES (1048576), (2097152), (5242880), (10485760)) v(r) WHERE ABS(sz - r) < 100
  UNION ALL SELECT tender_id, 'size_anomaly', 'medium', NULL, COUNT(*) FILTER (WHERE st = 'failed') || ' of ' || COUNT(*) FROM files GROUP BY tender_id HAVING COUNT(*) >= 3 AND COUNT(*) FILTER (WHERE st = 'failed') >= COUNT(*) * 0.5
  UNION ALL SELECT tender_id, 'empty_file', 'medium', doc_id, CAST(n AS VARCHAR) FROM files WHERE st = 'success' AND sz > 10240 AND n < 100
  UNION ALL SELECT tender_id, 'empty_file', 'low', doc_id, n || ' on ' || pages FROM files WHERE st = 'success' AND pages > 5 AND n > 0 AND n / pages < 50)"""


def x24_file_anomalies(t) -> DataFrame:
    files = materialize(_files(t), "files")
    return dc.file_anomalies(files).unionByName(dc.content_anomalies(files))


def x25_document_risk(t) -> DataFrame:
    """Completeness: a tender should have four documents; timing: a document that is late by its number."""
    files = materialize(_files(t), "files")
    odd = dc.file_anomalies(files).unionByName(dc.content_anomalies(files)).select("tender_id", "severity")
    whole = files.groupBy("tender_id").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 4).alias("completeness_score"))
    late = files.filter("doc_id % 13 < 2").select("tender_id", F.when(F.col("doc_id") % 13 == 0, "high").otherwise("low").alias("severity"))
    return dc.risk_contribution(files.select("tender_id").distinct(), whole, late, odd)


_X25_SQL = f"""WITH {_FILES_SQL},
cs AS (SELECT tender_id, LEAST(1.0{D}, COUNT(*) / 4.0{D}) AS c FROM files GROUP BY 1),
ts AS (SELECT tender_id, LEAST(1.0{D}, SUM(CASE WHEN doc_id % 13 = 0 THEN 0.7{D} ELSE 0.2{D} END) / 3) AS s FROM files WHERE doc_id % 13 < 2 GROUP BY 1),
fr AS (SELECT tender_id, COUNT(*) AS n, LEAST(40.0{D}, SUM(CASE severity WHEN 'high' THEN 10.0{D} WHEN 'medium' THEN 5.0{D} ELSE 2.0{D} END)) AS r FROM odd GROUP BY 1)
SELECT tender_id, ROUND(c, 3) AS completeness_score, ROUND(COALESCE(s, 0), 3) AS timing_score, COALESCE(n, 0) AS anomalies, ROUND(LEAST(100.0{D}, (1 - c) * 30 + COALESCE(s, 0) * 30 + COALESCE(r, 0)), 2) AS contribution
FROM cs LEFT JOIN ts USING (tender_id) LEFT JOIN fr USING (tender_id)"""

_X25_INSTITUTIONS = DOMAIN_SQL + f""", {_FILES_SQL},
j AS (SELECT procuring_entity, t.tender_id, f.doc_id, f.sz, f.st FROM tenders t LEFT JOIN files f ON f.tender_id = t.tender_id)
SELECT procuring_entity, COUNT(DISTINCT tender_id) AS total_tenders, COUNT(doc_id) AS total_documents, COUNT(*) FILTER (WHERE st = 'success') AS success_count, COUNT(*) FILTER (WHERE st = 'failed') AS failed_count, COUNT(*) FILTER (WHERE st = 'pending') AS pending_count,
  COUNT(*) FILTER (WHERE sz < 1024) AS tiny_files_count, COALESCE(ROUND(AVG(sz), 0), 0) AS avg_file_size_bytes, COUNT(*) FILTER (WHERE doc_id IS NULL) AS tenders_without_docs, ROUND(COUNT(doc_id) * 1.0{D} / COUNT(DISTINCT tender_id), 2) AS avg_docs_per_tender,
  COALESCE(ROUND(COUNT(*) FILTER (WHERE st = 'success') * 100.0{D} / NULLIF(COUNT(doc_id), 0), 2), 0) AS extraction_success_rate, ROUND(COUNT(*) FILTER (WHERE doc_id IS NULL) * 100.0{D} / COUNT(DISTINCT tender_id), 2) AS missing_doc_rate
FROM j GROUP BY 1"""


def _reports(t) -> DataFrame:
    """Orders by priority and year, and by priority alone, as cached responses: one file for each year, in the reports' shape."""
    o = t.raw("orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), "o_totalprice")
    rows = o.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("o_totalprice")).alias("v"))
    names = F.lit('{"descriptor":{"Select":[{"Value":"G0","Name":"Facts.procedure_type"},{"Value":"G1","Name":"Facts.year"},{"Value":"A0","Name":"Facts.tenders"},{"Value":"M0","Name":"Facts.all_tenders"}]},"dsr":{"DS":[{"PH":[{"DM0":[{"M0":')
    each = F.format_string('{"S":[{"N":"G0"},{"N":"G1"},{"N":"A0"}],"C":["%s",%d,%d,%d]}', "p", "y", "n", "v")
    text = F.concat(F.lit('{"results":[{"result":{"data":'), names, F.sum("n").cast("string"), F.lit('}]},{"DM1":['), F.array_join(F.sort_array(F.collect_list(each)), ","), F.lit("]}]}]}}}}]}"))
    path = fresh_path(t.spark, "reports")
    rows.groupBy("y").agg(text.alias("value")).write.partitionBy("y").text(path)
    return dim.read_responses(t.spark, path)


_S7_SQL = f"""WITH r AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, COUNT(*) AS n, FLOOR(SUM(o_totalprice)) AS v FROM orders GROUP BY 1, 2),
x AS (SELECT 'procedure_type' AS dimension, p AS label, 'year' AS measure, y{D} AS v FROM r UNION ALL SELECT 'procedure_type', p, 'tenders', n FROM r UNION ALL SELECT 'procedure_type', p, 'col_3', v FROM r
  UNION ALL SELECT 'year', CAST(y AS VARCHAR), 'tenders', n FROM r UNION ALL SELECT 'year', CAST(y AS VARCHAR), 'col_3', v FROM r)
SELECT dimension, label, measure, COUNT(*) AS rows, SUM(v) AS total, ROUND(AVG(v), 6) AS mean, MIN(v) AS low, MAX(v) AS high FROM x GROUP BY 1, 2, 3"""


def x30_table_items(t) -> DataFrame:
    """Order lines as extracted tables, a heading first, every fourth order's in Macedonian, and back to items."""
    text = F.col("l_quantity").cast("long").cast("string")
    lines = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.array(F.concat(F.lit(" item "), F.col("l_partkey").cast("string")), text, F.when(F.col("l_linenumber") % 5 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string"))))).alias("rows"))
    head = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("Назив"), F.lit("Количина"), F.lit("Цена"))).otherwise(F.array(F.lit("Item name"), F.lit("Quantity"), F.lit("Unit price")))
    return table_rows_to_items(lines.select("doc_id", F.concat(F.array(head), "rows").alias("cells"))).drop("row")


def p54_cluster_statistics(t) -> DataFrame:
    return c.cluster_statistics(u.merged_clusters(_clusters(t)), t.tenders, t.bidders)


def p54_cluster_companies(t) -> DataFrame:
    """Companies of clusters by how many they are in and the largest of them."""
    members = materialize(u.merged_clusters(_clusters(t)), "clusters")
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return members.join(size, "cluster").groupBy(F.col("member").alias("company_name")).agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))


def p36_monthly_offers(t) -> DataFrame:
    """Offers, wins and value per company and month."""
    j = t.bidders.join(t.tenders.select("tender_id", "publication_date"), "tender_id")
    return j.groupBy("company_name", F.date_trunc("month", "publication_date").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("offers"), F.count_if("is_winner").alias("wins"), F.sum("bid_amount_mkd").alias("value"))


def p36_repeat_customers(t) -> DataFrame:
    """Per company: wins, buyers that they came from, the share of wins beyond a buyer's first, and the mean discount against estimates."""
    w = t.bidders.filter("is_winner").join(t.tenders.select("tender_id", "procuring_entity", "estimated_value_mkd"), "tender_id")
    per = w.groupBy("company_name").agg(F.count(F.lit(1)).alias("wins"), F.count_distinct("procuring_entity").alias("customers"), F.round(F.avg(F.when(F.col("estimated_value_mkd") > 0, (F.col("estimated_value_mkd") - F.col("bid_amount_mkd")) * 100.0 / F.col("estimated_value_mkd"))), 4).alias("discount"))
    return per.withColumn("repeat_rate", F.round((F.col("wins") - F.col("customers")) * 100.0 / F.col("wins"), 4))


def p26_product_statistics(t) -> DataFrame:
    """Of all product lines by code and year: lines, tenders, names, companies, quantity and spread of unit prices."""
    i = t.items.withColumn("year", F.year("offered_on"))
    return i.groupBy("cpv_code", "year").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("tender_id").alias("tenders"), F.count_distinct("name").alias("names"), F.count_distinct("company_name").alias("companies"), F.sum("quantity").alias("quantity"), F.round(F.min("unit_price"), 6).alias("low"), F.round(F.max("unit_price"), 6).alias("high"))


def p26_product_search(t) -> DataFrame:
    """The 50 dearest lines whose name holds a word, with code and quantity within bounds."""
    hit = F.contains(F.lower("name"), F.lit("gear")) & F.col("quantity").between(10, 40) & (F.col("cpv_code") < "40")
    return t.items.filter(hit).select("tender_id", "company_name", "name", "cpv_code", "quantity", F.round("unit_price", 6).alias("unit_price")).distinct().orderBy(F.desc("unit_price"), "tender_id", "company_name", "name", "quantity").limit(50)


def _m2_sql() -> str:
    both, ap = "est > 0 AND act > 0", "(act - est) / NULLIF(est, 0)"
    yes = lambda test: f"CASE WHEN {test} THEN 1.0{D} ELSE 0.0{D} END"
    num = lambda value, test: f"ROUND(COALESCE(CASE WHEN {test} THEN {value} END, 0), 6)"
    some, judged, cov, z = "n >= 2", "n >= 2 AND bid > 0 AND mean > 0", "sd / NULLIF(mean, 0)", "(mean - bid) / NULLIF(sd, 0)"
    made = {
        "estimated_value_mkd": "est", "actual_value_mkd": "act", "has_estimated_value": yes("est > 0"), "has_actual_value": yes("act > 0"), "price_vs_estimate_ratio": num("act / est", both), "price_deviation_from_estimate": num(ap, both), "price_above_estimate": yes(f"{both} AND {ap} > 0"),
        "price_below_estimate": yes(f"{both} AND {ap} < 0"), "price_exact_match_estimate": yes(f"{both} AND ABS({ap}) < 0.01{D}"), "price_very_close_estimate": yes(f"{both} AND ABS({ap}) < 0.05{D}"), "price_deviation_large": yes(f"{both} AND ABS({ap}) > 0.2{D}"), "price_deviation_very_large": yes(f"{both} AND ABS({ap}) > 0.5{D}"),
        "bid_mean": num("mean", some), "bid_median": num("median", some), "bid_std": num("sd", some), "bid_min": num("lo", some), "bid_max": num("hi", some), "bid_range": num("hi - lo", some), "bid_coefficient_of_variation": num(cov, some), "bid_low_variance": yes(f"{some} AND {cov} < 0.05{D}"), "bid_very_low_variance": yes(f"{some} AND {cov} < 0.02{D}"),
        "winner_vs_mean_ratio": num("bid / mean", judged), "winner_vs_median_ratio": num("bid / NULLIF(median, 0)", judged), "winner_bid_z_score": num(z, judged), "winner_extremely_low": yes(f"{judged} AND {z} > 2"), "value_log": num("log10(est + 1)", "est > 0"), "value_small": yes("est > 0 AND est < 500000"),
        "value_medium": yes("est >= 500000 AND est < 5000000"), "value_large": yes("est >= 5000000 AND est < 20000000"), "value_very_large": yes("est >= 20000000"),
    }
    columns = ", ".join(f"{e} AS {n}" for n, e in made.items())
    return DOMAIN_SQL + f""", b AS (SELECT tender_id, COUNT(*) AS n, AVG(bid_amount_mkd) AS mean, quantile_cont(bid_amount_mkd, 0.5) AS median, stddev_pop(bid_amount_mkd) AS sd, MIN(bid_amount_mkd) AS lo, MAX(bid_amount_mkd) AS hi, MAX(CASE WHEN is_winner THEN bid_amount_mkd END) AS won FROM bidders WHERE bid_amount_mkd <> 0 GROUP BY 1),
    x AS (SELECT t.tender_id, COALESCE(estimated_value_mkd, 0) AS est, COALESCE(actual_value_mkd, 0) AS act, COALESCE(n, 0) AS n, mean, median, sd, lo, hi, CASE WHEN actual_value_mkd > 0 THEN actual_value_mkd ELSE COALESCE(won, 0) END AS bid FROM tenders t LEFT JOIN b ON b.tender_id = t.tender_id)
    SELECT tender_id, {columns} FROM x"""


_M9_SQL = FLAGS_SQL + f""", {_FILES_SQL}, dn AS (SELECT tender_id, COUNT(*) AS docs FROM files GROUP BY 1), fn AS (SELECT tender_id, COUNT(*) AS flags, MAX(score){D} AS worst FROM flags GROUP BY 1),
x AS (SELECT t.*, COALESCE(num_bidders, 0) AS nb, COALESCE(estimated_value_mkd, 0) AS est, COALESCE(actual_value_mkd, 0) AS act, COALESCE(docs, 0) AS docs, COALESCE(flags, 0) AS flags, COALESCE(worst, 0) AS worst, closing_date - publication_date AS days FROM tenders t LEFT JOIN dn ON dn.tender_id = t.tender_id LEFT JOIN fn ON fn.tender_id = t.tender_id)
SELECT tender_id, CASE WHEN winner <> '' THEN 1 ELSE 0 END AS has_winner, nb AS num_bidders, CASE WHEN nb = 1 THEN 1 ELSE 0 END AS single_bidder, nb AS bidder_count, est AS estimated_value_mkd, act AS actual_value_mkd, CASE WHEN est > 0 OR act > 0 THEN 1 ELSE 0 END AS has_price_data,
  ROUND(CASE WHEN est > 0 AND act > 0 THEN ABS(act / est - 1) ELSE 0 END, 6) AS price_deviation, ROUND(CASE WHEN est > 0 AND act > 0 THEN act / est ELSE 1 END, 6) AS price_ratio, CASE WHEN act > 0 THEN act ELSE est END AS bid_mean, 0.0{D} AS bid_std, 0.0{D} AS bid_cv, days AS deadline_days, CASE WHEN days < 15 THEN 1 ELSE 0 END AS short_deadline,
  docs AS num_documents, amendment_count, CASE WHEN amendment_count > 0 THEN 1 ELSE 0 END AS has_amendments, flags AS flag_count, worst AS max_flag_score, CASE WHEN flags > 0 THEN worst ELSE 0 END AS avg_flag_score FROM x"""


def m9_batch_feature_set(t) -> DataFrame:
    own, flags = flag_tables(t)
    return fs.batch_feature_set(own.tenders, _files(t).select("tender_id"), flags)


_RECURSIVE = DOMAIN_SQL.replace("WITH bids0", "WITH RECURSIVE bids0", 1)
_ALL = {
    "m2_price_feature_set": (lambda t: fs.price_feature_set(t.tenders, t.bidders), _m2_sql()),
    "m9_batch_feature_set": (m9_batch_feature_set, _M9_SQL),
    "x24_file_anomalies": (x24_file_anomalies, f"WITH {_FILES_SQL} SELECT tender_id, kind, severity, doc_id, detail FROM odd"),
    "x25_document_risk": (x25_document_risk, _X25_SQL),
    "x25_institution_documents": (lambda t: dc.institution_document_statistics(t.tenders, _files(t)), _X25_INSTITUTIONS),
    "x30_table_items": (x30_table_items, f"SELECT l_orderkey AS doc_id, 'item ' || l_partkey AS name, FLOOR(l_quantity){D} AS quantity, CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber{D} END AS unit_price FROM lineitem"),
    "s7_report_statistics": (lambda t: dim.dimension_statistics(dim.response_rows(_reports(t))), _S7_SQL),
    "p54_cluster_statistics": (p54_cluster_statistics, _RECURSIVE + _CLUSTERS + f"""
      , sizes AS (SELECT cluster, COUNT(*) AS members FROM merged GROUP BY 1),
      met AS (SELECT cluster, tender_id, bool_or(is_winner) AS won FROM bidders JOIN merged ON member = company_name GROUP BY 1, 2 HAVING COUNT(*) >= 2),
      per AS (SELECT cluster, COUNT(*) AS tenders, COUNT(*) FILTER (WHERE won) AS wins, COALESCE(SUM(CASE WHEN won THEN actual_value_mkd END), 0) AS value FROM met JOIN tenders USING (tender_id) GROUP BY 1)
      SELECT cluster, members, COALESCE(tenders, 0) AS tenders, COALESCE(wins, 0) AS wins, COALESCE(value, 0) AS value, CASE WHEN members >= 5 THEN 'high' WHEN members >= 3 THEN 'medium' ELSE 'low' END AS level FROM sizes LEFT JOIN per USING (cluster)"""),
    "p54_cluster_companies": (p54_cluster_companies, _RECURSIVE + _CLUSTERS + ", sizes AS (SELECT cluster, COUNT(*) AS n FROM merged GROUP BY 1) SELECT member AS company_name, COUNT(*) AS clusters, MAX(n) AS largest FROM merged JOIN sizes USING (cluster) GROUP BY 1"),
    "p36_monthly_offers": (p36_monthly_offers, DOMAIN_SQL + "SELECT company_name, CAST(date_trunc('month', publication_date) AS DATE) AS month, COUNT(*) AS offers, COUNT(*) FILTER (WHERE is_winner) AS wins, SUM(bid_amount_mkd) AS value FROM bidders JOIN tenders USING (tender_id) GROUP BY 1, 2"),
    "p36_repeat_customers": (p36_repeat_customers, DOMAIN_SQL + f"SELECT company_name, COUNT(*) AS wins, COUNT(DISTINCT procuring_entity) AS customers, ROUND(AVG(CASE WHEN estimated_value_mkd > 0 THEN (estimated_value_mkd - bid_amount_mkd) * 100.0{D} / estimated_value_mkd END), 4) AS discount, ROUND((COUNT(*) - COUNT(DISTINCT procuring_entity)) * 100.0{D} / COUNT(*), 4) AS repeat_rate FROM bidders JOIN tenders USING (tender_id) WHERE is_winner GROUP BY 1"),
    "p26_product_statistics": (p26_product_statistics, DOMAIN_SQL + "SELECT cpv_code, year(offered_on) AS year, COUNT(*) AS lines, COUNT(DISTINCT tender_id) AS tenders, COUNT(DISTINCT name) AS names, COUNT(DISTINCT company_name) AS companies, SUM(quantity) AS quantity, ROUND(MIN(unit_price), 6) AS low, ROUND(MAX(unit_price), 6) AS high FROM items GROUP BY 1, 2"),
    "p26_product_search": (p26_product_search, DOMAIN_SQL + "SELECT DISTINCT tender_id, company_name, name, cpv_code, quantity, ROUND(unit_price, 6) AS unit_price FROM items WHERE contains(lower(name), 'gear') AND quantity BETWEEN 10 AND 40 AND cpv_code < '40' ORDER BY unit_price DESC, tender_id, company_name, name, quantity LIMIT 50"),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
