"""Registered queries of ingest and identity resolution, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.functions import cleaning as c
from bidscope.functions import text as x
from bidscope.operators import entities as e
from bidscope.operators import ingest as g
from bidscope.plans import other_queries as o
from bidscope.sources import ocds
from bidscope.sources.domain import AS_OF, DOMAIN_SQL


def last():
    return F.substring("tender_id", -1, 1)
_CYRILLIC = "translate(" + "".join("replace(" for _ in c.DIGRAPHS) + "lower(s_name)" + "".join(f", '{a}', '{b}')" for a, b in c.DIGRAPHS) + f", '{c.LATIN}', '{c.CYRILLIC}')"


def _upsert(t):
    """An older copy without some tenders and winners, and a newer one without others and with some values raised."""
    rows = t.tenders.select("tender_id", "title", "winner", "estimated_value_mkd")
    old = rows.filter(last() != "5").withColumn("winner", F.when(last() != "4", F.col("winner")))
    new = rows.filter(last() != "3").withColumns({"estimated_value_mkd": F.col("estimated_value_mkd") + F.when(last() == "7", 1.0).otherwise(0.0), "title": F.when(last() != "8", F.col("title"))})
    return g.upsert_with_history(old, new, ["tender_id"])


def _bid_upsert(t):
    rows = t.bidders.select("tender_id", "company_name", "bid_amount_mkd")
    old = rows.filter(last() != "5")
    new = rows.filter(last() != "3").withColumn("bid_amount_mkd", F.when(last() == "7", F.col("bid_amount_mkd") + 1).when(last() != "9", F.col("bid_amount_mkd")))
    return c.merge(old, new, ["tender_id", "company_name"])


def _absent(t):
    rows = t.amendments.select("tender_id", "n", "amendment_date")
    return g.insert_absent(rows.filter(last() != "5"), rows.withColumn("amendment_date", F.date_add("amendment_date", 1)), ["tender_id", "n"])


def _children(t):
    objects = F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("lot"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("flag"))))
    raw = t.raw("lineitem").groupBy("l_orderkey").agg(objects.alias("raw"))
    rows = g.child_rows(raw, ["l_orderkey"], "raw", "struct<lot:int,amount:double,flag:string>")
    return rows.groupBy("l_orderkey", "flag").agg(F.count(F.lit(1)).alias("lots"), F.round(F.sum("amount"), 2).alias("amount"))


def _repaired(t):
    json = ocds.from_orders(t.raw("orders"), t.raw("lineitem"))
    releases = json.select(F.from_json("json", ocds.RELEASE_SCHEMA).alias("r")).select("r.*")
    stored = releases.select("ocid", F.when(F.substring("ocid", -1, 1) == "1", 1.0).alias("actual_value_mkd"))
    return ocds.repaired_values(stored, releases).select("ocid", F.round("actual_value_mkd", 4).alias("actual_value_mkd"))


def _validated(t):
    value = F.col("estimated_value_mkd")
    raw = t.tenders.select(
        F.when(last() != "9", F.col("tender_id")).otherwise("  ").alias("tender_id"), F.when(last() == "1", "x").otherwise(F.col("title")).alias("title"), F.lit(None).cast("string").alias("description"), "procuring_entity",
        F.when(last() == "2", -value).when(last() == "8", value * 1e6).otherwise(value).alias("estimated_value_mkd"), "publication_date", "closing_date",
    )
    good, _ = c.validate_tenders(raw)
    return good.select("tender_id", "title", "estimated_value_mkd", F.array_join("issues", ",").alias("issues"))


def _registry(t):
    """Suppliers with numbers of several lengths; ``lpad`` cuts what is longer, so the length is that of the key at least."""
    key = F.col("s_suppkey")
    padded = lambda n, fill: F.lpad(key.cast("string"), F.greatest(F.length(key.cast("string")), n), fill)
    return t.raw("supplier").select("s_suppkey", padded(F.lit(4), "1").alias("registration"), F.lpad(key.cast("string"), (key % 8 + 9).cast("int"), "2").alias("tax"))


def _identities(t):
    s = t.raw("supplier")
    k = F.col("s_suppkey")
    full = {"source_id": k.cast("string"), "registration": F.concat(F.lit("R"), k), "tax": F.concat(F.lit("T"), k), "name": F.col("s_name")}
    registry = s.select(k.alias("company_id"), *[v.alias(n) for n, v in full.items()])
    way = {"source_id": 0, "registration": 1, "tax": 2, "name": 3}
    incoming = s.select(k.alias("row_id"), *[F.when(k % 5 == way[n], v if n != "name" else F.concat(v, F.lit(" doo"))).otherwise("?").alias(n) for n, v in full.items()])
    return g.resolved_identities(incoming, registry)


def _contacts(t):
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    companies = s.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"))
    mail = F.concat(F.lit("c"), F.col("s_suppkey"), F.lit("@example.com"))
    contacts = s.filter("s_suppkey % 4 <> 0").select(F.concat("s_name", F.lit(" Ltd.")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "elsewhere").otherwise(F.lower("n_name")).alias("city"), mail.alias("email"))
    return g.merged_contacts(companies, contacts)


def _scripts(t):
    s = t.raw("supplier")
    registry = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper(c.transliterate(F.col("s_name"))), F.lit(" ДОО"))).otherwise(F.concat("s_name", F.lit(" DOO"))).alias("name"))
    return e.match_companies(s.select(F.col("s_name").alias("name")), registry)


_ALL = {
    "s2_release_ids": (
        lambda t: t.raw("orders").select("o_orderkey", ocds.ocid_uuid(F.concat(F.lit("ocds-70d2nz-00000000-0000-4000-8000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).alias("uuid")),
        "SELECT o_orderkey, '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS uuid FROM orders",
    ),
    "s3_child_rows": (_children, "SELECT l_orderkey, l_returnflag AS flag, COUNT(*) AS lots, ROUND(SUM(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1, 2"),
    "s4_upsert_history": (_upsert, """, o AS (
      SELECT tender_id, title, CASE WHEN tender_id NOT LIKE '%4' THEN winner END AS winner, estimated_value_mkd AS v FROM tenders WHERE tender_id NOT LIKE '%5'),
    n AS (
      SELECT tender_id, CASE WHEN tender_id NOT LIKE '%8' THEN title END AS title, winner, estimated_value_mkd + CASE WHEN tender_id LIKE '%7' THEN 1 ELSE 0 END AS v
      FROM tenders WHERE tender_id NOT LIKE '%3'),
    m AS (
      SELECT o.tender_id, COALESCE(n.title, o.title) AS title, COALESCE(n.winner, o.winner) AS winner, COALESCE(n.v, o.v) AS v,
             (COALESCE(n.title, o.title), COALESCE(n.winner, o.winner), COALESCE(n.v, o.v)) IS DISTINCT FROM (o.title, o.winner, o.v) AS changed
      FROM o LEFT JOIN n ON o.tender_id = n.tender_id)
    SELECT o.tender_id, o.title, o.winner, o.v AS estimated_value_mkd, 1 AS version, NOT changed AS current FROM o JOIN m ON o.tender_id = m.tender_id
    UNION ALL SELECT tender_id, title, winner, v, 2, TRUE FROM m WHERE changed
    UNION ALL SELECT tender_id, title, winner, v, 1, TRUE FROM n WHERE tender_id NOT IN (SELECT tender_id FROM o)"""),
    "s5_bid_upsert": (_bid_upsert, """
    SELECT tender_id, company_name, bid_amount_mkd + CASE WHEN tender_id LIKE '%7' THEN 1 ELSE 0 END AS bid_amount_mkd FROM bidders"""),
    "s5_absent_amendments": (_absent, """
    SELECT tender_id, n, amendment_date + CASE WHEN tender_id LIKE '%5' THEN 1 ELSE 0 END AS amendment_date FROM amendments"""),
    "s6_filtered_export": (
        lambda t: g.export_csv(t.tenders.filter("status = 'awarded' and estimated_value_mkd >= 3e6").select("tender_id", "title", "winner", "estimated_value_mkd"), [F.desc("estimated_value_mkd"), F.col("tender_id")], 500),
        """
    SELECT tender_id, title, winner, estimated_value_mkd FROM tenders WHERE status = 'awarded' AND estimated_value_mkd >= 3e6 ORDER BY estimated_value_mkd DESC, tender_id LIMIT 500""",
    ),
    "s9_repaired_values": (_repaired, """
    SELECT 'ocds-70d2nz-00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS ocid,
           CASE WHEN o_orderkey % 10 = 1 THEN 1.0::DOUBLE ELSE ROUND(MAX(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * CASE WHEN l_linenumber % 2 = 1 THEN 61.5::DOUBLE ELSE 1 END END), 4) END AS actual_value_mkd
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""),
    "c1_valid_tenders": (_validated, """
    SELECT tender_id, CASE WHEN tender_id LIKE '%1' OR title IS NULL THEN procuring_entity ELSE title END AS title,
           CASE WHEN tender_id LIKE '%2' THEN NULL WHEN tender_id LIKE '%8' THEN estimated_value_mkd * 1e6 ELSE estimated_value_mkd END AS estimated_value_mkd,
           concat_ws(',', CASE WHEN tender_id LIKE '%1' OR title IS NULL THEN 'title' END, CASE WHEN tender_id LIKE '%2' THEN 'negative value' END,
                     CASE WHEN tender_id LIKE '%8' AND estimated_value_mkd * 1e6 > 1e9 THEN 'very large value' END) AS issues
    FROM tenders WHERE tender_id NOT LIKE '%9'"""),
    "c2_registry_issues": (
        lambda t: _registry(t).select("s_suppkey", F.array_join(g.registry_issues(F.col("registration"), F.col("tax")), ",").alias("issues")),
        """
    SELECT s_suppkey, concat_ws(',', CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 5 THEN 'registration number' END, CASE WHEN s_suppkey % 8 + 9 NOT BETWEEN 10 AND 15 THEN 'tax number' END) AS issues FROM supplier""",
    ),
    "c5_run_statistics": (lambda t: g.run_statistics(c.classify_changes(o._hashed(t, False), o._hashed(t, True))), """
    SELECT COUNT(*) AS found, COUNT(*) FILTER (WHERE tender_id LIKE '%5') AS new, COUNT(*) FILTER (WHERE tender_id LIKE '%7') AS updated,
           COUNT(*) FILTER (WHERE tender_id NOT LIKE '%5' AND tender_id NOT LIKE '%7') AS unchanged
    FROM tenders WHERE tender_id NOT LIKE '%3'"""),
    "c8_detected_status": (
        lambda t: t.tenders.select("tender_id", g.detected_status(F.when(last() < "3", F.initcap("status")), F.when(last() < "6", F.col("winner")), F.when(last() < "9", F.col("closing_date")), F.when(F.col("title").contains("gear"), "Cancelled: gear").otherwise(F.col("title")), AS_OF).alias("found")),
        """
    SELECT tender_id, CASE WHEN substr(tender_id, -1) < '3' THEN status WHEN substr(tender_id, -1) < '6' AND winner IS NOT NULL THEN 'awarded'
                           WHEN substr(tender_id, -1) < '9' AND closing_date < DATE '2001-08-01' THEN 'closed' WHEN contains(title, 'gear') THEN 'cancelled' ELSE 'open' END AS found
    FROM tenders""",
    ),
    "c9_procedure_names": (lambda t: t.tenders.groupBy("procedure_type", g.procedure_name(F.col("procedure_type")).alias("common")).agg(F.count(F.lit(1)).alias("tenders")), """
    SELECT procedure_type, CASE procedure_type WHEN 'NegotiatedProcedureWithoutPriorPublication' THEN 'negotiated' WHEN 'LowEstimatedValueProcedure' THEN 'low value' WHEN 'Open' THEN 'open'
                                               WHEN 'QualificationSystem' THEN 'qualification' ELSE 'simplified open' END AS common, COUNT(*) AS tenders
    FROM tenders GROUP BY 1, 2"""),
    "c17_lasting_emails": (
        lambda t: g.lasting_emails(x.extract_entities(t.raw("documents"), {"EMAIL": x.ENTITIES["EMAIL"]}), "entity", t.spark.createDataFrame([(f"mail{i}.example.com",) for i in (1, 3, 5)], "domain string")).select("doc_id", "entity", "domain"),
        f"""
    SELECT doc_id, entity, lower(split_part(entity, '@', 2)) AS domain
    FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{x.ENTITIES["EMAIL"]}'))) AS entity FROM documents) u
    WHERE lower(split_part(entity, '@', 2)) NOT IN ('mail1.example.com', 'mail3.example.com', 'mail5.example.com')""",
    ),
    "j6_yearly_wins": (lambda t: g.yearly_wins(t.bidders, t.tenders), """
    SELECT company_name, year, wins, value, ROUND(MAX(wins) OVER w / SUM(wins) OVER w, 6) AS best_share
    FROM (SELECT company_name, year(publication_date) AS year, COUNT(*) AS wins, SUM(bid_amount_mkd) AS value FROM bidders JOIN tenders USING (tender_id) WHERE is_winner GROUP BY 1, 2) y
    WINDOW w AS (PARTITION BY company_name)"""),
    "j7_listed_awards": (lambda t: g.listed_awards(t.tenders, 2), """
    , per AS (SELECT winner, category, COUNT(*) AS n FROM tenders WHERE winner IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
    lists AS (SELECT winner, list(category) AS categories FROM per WHERE n >= 2 GROUP BY 1)
    SELECT p.winner, p.category, p.n AS awards, CAST(len(categories) AS INTEGER) AS listed FROM per p JOIN lists l ON p.winner = l.winner AND list_contains(categories, p.category)"""),
    "j8_term_hits": (
        lambda t: g.term_hits(t.items, ["gear", "plate", "bolt", "o"]).groupBy("term").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("name").alias("names"), F.round(F.avg("unit_price"), 4).alias("mean_price")),
        """
    SELECT term, COUNT(*) AS items, COUNT(DISTINCT name) AS names, ROUND(AVG(unit_price), 4) AS mean_price
    FROM items JOIN (VALUES ('gear'), ('plate'), ('bolt'), ('o')) v(term) ON contains(lower(name), term) GROUP BY 1""",
    ),
    "j11_cross_script": (_scripts, f"""
    SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN upper({_CYRILLIC}) || ' ДОО' ELSE s_name || ' DOO' END AS registered, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS pass
    FROM supplier"""),
    "j12_identities": (_identities, """
    SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey END AS company_id, CASE s_suppkey % 5 WHEN 0 THEN 'source_id' WHEN 1 THEN 'registration' WHEN 2 THEN 'tax' WHEN 3 THEN 'name' END AS how
    FROM supplier"""),
    "j13_contacts": (_contacts, """
    SELECT s_suppkey AS company_id, 'c' || s_suppkey || '@example.com' AS email, CASE WHEN s_suppkey % 3 = 0 THEN 'name' ELSE 'name and city' END AS by FROM supplier WHERE s_suppkey % 4 <> 0"""),
    "j15_address_classes": (
        lambda t: g.address_classes(t.raw("customer").select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("No. "), F.floor(F.col("c_custkey") / 3), F.when(F.col("c_custkey") % 2 == 0, ", ").otherwise(" - "), "c_mktsegment").alias("address"))),
        """
    SELECT company_id, class_id, related
    FROM (SELECT c_custkey AS company_id, MIN(c_custkey) OVER w AS class_id, COUNT(*) OVER w - 1 AS related FROM customer WINDOW w AS (PARTITION BY c_custkey // 3, c_mktsegment)) x WHERE related > 0""",
    ),
    "a7_nested_winners": (lambda t: g.nested_winners(t.tenders), """
    SELECT procuring_entity, '[' || string_agg('{"winner":"' || winner || '","awards":' || n || '}', ',' ORDER BY place) || ']' AS winners
    FROM (SELECT procuring_entity, winner, COUNT(*) AS n, row_number() OVER (PARTITION BY procuring_entity ORDER BY COUNT(*) DESC, winner) AS place FROM tenders WHERE winner IS NOT NULL GROUP BY 1, 2) x
    WHERE place <= 3 GROUP BY 1"""),
    "o5_both_marketplaces": (lambda t: g.both_marketplaces(t.tenders, t.items), """
    SELECT source, year, COUNT(*) AS n, ROUND(SUM(value), 2) AS value
    FROM (SELECT 'tenders' AS source, year(publication_date) AS year, estimated_value_mkd AS value FROM tenders UNION ALL SELECT 'marketplace', year(offered_on), quantity * unit_price FROM items) x GROUP BY 1, 2"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + sql if not sql.startswith("SELECT") else sql for name, (_, sql) in _ALL.items()}
