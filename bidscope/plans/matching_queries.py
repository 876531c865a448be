"""Registered queries of what belongs together, each with its SQL.

Searches ask for every row whose number is divisible by 100, against all rows.  Suppliers stand for people who are named
in tenders, customers for leads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.functions import cleaning as c
from bidscope.functions import text as x
from bidscope.operators import graph as g
from bidscope.operators import matching as m
from bidscope.sources.domain import AS_OF, DOMAIN_SQL

TERMS = ["gear", "blue bolt", "small ring of steel", "red widget"]
_ASKED = "CAST(substr(tender_id, 2) AS BIGINT) % 100 = 0"


def _asked(t):
    return t.tenders.filter("cast(substr(tender_id, 2) as bigint) % 100 = 0")


def _doors(t):
    """Awards between nations: of the buyer, and of the winner's seat."""
    w = t.bidders.filter("is_winner").select("tender_id", F.col("company_city").alias("dst"), "bid_amount_mkd")
    return w.join(t.tenders.select("tender_id", F.substring_index("procuring_entity", "|", 1).alias("src")), "tender_id").filter("dst is not null").groupBy("src", "dst").agg(F.sum("bid_amount_mkd").alias("value"))


def _mentions(t):
    line = t.raw("lineitem")
    name = F.concat(F.lit("person "), F.col("l_partkey"))
    return line.select(name.alias("name"), F.when(F.col("l_partkey") % 3 == 0, "PERSON").otherwise("ORG").alias("kind"), F.concat(F.lit("T"), F.col("l_orderkey")).alias("tender_id"), (F.col("l_linenumber") / 8).alias("confidence"))


_MENTIONS = ", mentions AS (SELECT 'person ' || l_partkey AS name, CASE WHEN l_partkey % 3 = 0 THEN 'PERSON' ELSE 'ORG' END AS kind, 'T' || l_orderkey AS tender_id, l_linenumber / CAST(8 AS DOUBLE) AS confidence FROM lineitem)"


def _items(t):
    return t.items.withColumnRenamed("brand", "unit")


def _leads(t):
    k = F.col("c_custkey")
    mail = lambda label: F.concat(F.lit(label), k, F.lit("@x.mk"))
    status = F.when(k % 11 == 0, "bounced").when(k % 13 == 0, "do_not_contact").otherwise("sent")
    leads = t.raw("customer").select(k.alias("lead_id"), mail("Lead").alias("email"), F.when(k % 9 > 0, F.lpad((k % 50 + 1).cast("string"), 2, "0")).alias("division"), status.alias("status"), (k % 17 == 0).alias("bounced"), F.when(k % 4 == 0, F.date_sub(F.lit(AS_OF), (k % 12).cast("int"))).alias("last_sent"))
    listed = lambda by: t.raw("customer").filter(k % by == 1).select(mail("lead").alias("email"))
    return m.open_matches(t.tenders, leads, listed(5), listed(7), AS_OF, days=900)


def _specifications(t, **levels):
    v = t.raw("embeddings")
    return m.similar_specifications(v, v.filter("vec_id % 100 = 0"), t.tenders, **levels)


_LEVELS = {"least": 0.25, "clone": 0.35, "reuse": 0.3}
_PAIRS = """, near AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS place
  FROM (SELECT a.vec_id AS q, b.vec_id AS v, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) x),
pairs AS (
  SELECT n1, n2, a.procuring_entity AS institution_1, b.procuring_entity AS institution_2, cosine, a.procuring_entity = b.procuring_entity AS same_institution, COALESCE(a.winner = b.winner, FALSE) AS same_winner
  FROM (SELECT DISTINCT LEAST(q, v) AS n1, GREATEST(q, v) AS n2, cosine FROM near WHERE place <= 10 AND cosine >= 0.25) p JOIN tenders a ON a.tender_id = 'T' || n1 JOIN tenders b ON b.tender_id = 'T' || n2)"""
_TRI = """, words AS (SELECT name, '  ' || unnest(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) || ' ' AS w FROM (SELECT DISTINCT p_name AS name FROM part) x),
tri AS (SELECT DISTINCT name, substr(w, i, 3) AS t FROM (SELECT name, w, unnest(range(1, length(w) - 1)) AS i FROM words) x),
sized AS (SELECT name, COUNT(*) AS n FROM tri GROUP BY 1),
alike AS (
  SELECT a, b, ROUND(both_ / CAST(x.n + y.n - both_ AS DOUBLE), 6) AS similarity
  FROM (SELECT p.name AS a, q.name AS b, COUNT(*) AS both_ FROM tri p JOIN tri q ON p.t = q.t AND p.name < q.name GROUP BY 1, 2) z JOIN sized x ON x.name = a JOIN sized y ON y.name = b WHERE both_ / CAST(x.n + y.n - both_ AS DOUBLE) > 0.3)"""

_ALL = {
    "c12_search_variants": (lambda t: t.raw("part").select("p_name").distinct().select("p_name", F.array_join(c.search_variants(F.col("p_name")), "|").alias("variants")), "SELECT p_name, CASE WHEN p_name = v THEN p_name ELSE p_name || '|' || v END AS variants FROM (SELECT DISTINCT p_name, translate(" + "".join("replace(" for _ in c.DIGRAPHS) + "lower(p_name)" + "".join(f", '{a}', '{b}')" for a, b in c.DIGRAPHS) + f", '{c.LATIN}', '{c.CYRILLIC}') AS v FROM part) x"),
    "g17_revolving_doors": (lambda t: g.revolving_doors(_doors(t)), """
    , e AS (SELECT split_part(procuring_entity, '|', 1) AS src, company_city AS dst, SUM(bid_amount_mkd) AS value FROM bidders JOIN tenders USING (tender_id) WHERE is_winner AND company_city IS NOT NULL GROUP BY 1, 2)
    SELECT name, buyer_edges, buyer_value, supplier_edges, supplier_value FROM (SELECT src AS name, COUNT(*) AS buyer_edges, SUM(value) AS buyer_value FROM e GROUP BY 1) b
    JOIN (SELECT dst AS name, COUNT(*) AS supplier_edges, SUM(value) AS supplier_value FROM e GROUP BY 1) s USING (name)"""),
    "g27_person_conflicts": (lambda t: m.person_conflicts(_mentions(t).filter("kind = 'PERSON'"), t.tenders), _MENTIONS + """
    , pm AS (SELECT name, tender_id, procuring_entity, winner, c FROM (SELECT name, tender_id, MAX(confidence) AS c FROM mentions WHERE kind = 'PERSON' GROUP BY 1, 2) x JOIN tenders USING (tender_id))
    SELECT a.name, a.procuring_entity AS institution, b.winner AS company, COUNT(DISTINCT a.tender_id) + COUNT(DISTINCT b.tender_id) AS mentions, ROUND(AVG(a.c), 4) AS confidence
    FROM pm a JOIN pm b ON a.name = b.name AND a.tender_id <> b.tender_id WHERE a.procuring_entity IS NOT NULL AND b.winner IS NOT NULL AND a.procuring_entity <> b.winner GROUP BY 1, 2, 3
    HAVING COUNT(DISTINCT a.tender_id) >= 2 OR COUNT(DISTINCT b.tender_id) >= 2"""),
    "g28_mention_network": (lambda t: m.mention_network(_mentions(t), t.raw("part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("person "), "p_partkey").alias("name"))), _MENTIONS + """
    , d AS (SELECT DISTINCT name, kind, tender_id FROM mentions)
    SELECT name, other, kind, tenders FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY tenders DESC, other, kind) AS place
      FROM (SELECT a.name, b.name AS other, b.kind, COUNT(*) AS tenders FROM d a JOIN d b ON a.tender_id = b.tender_id AND a.name <> b.name WHERE CAST(substr(a.name, 8) AS BIGINT) % 100 = 0 GROUP BY 1, 2, 3) x) y WHERE place <= 50"""),
    "g28_mention_statistics": (lambda t: m.mention_statistics(_mentions(t)), _MENTIONS + """
    SELECT kind, COUNT(*) AS mentions, COUNT(DISTINCT name) AS names, COUNT(DISTINCT tender_id) AS tenders, ROUND(AVG(confidence), 4) AS mean_confidence FROM mentions GROUP BY 1"""),
    "j9_similar_part_names": (lambda t: x.similar_names(t.raw("part").select(F.col("p_name").alias("name"))), _TRI + "SELECT a, b, similarity FROM alike"),
    "p29_item_aggregates": (lambda t: m.item_aggregates(_items(t)), """
    SELECT name, brand AS unit, COUNT(*) AS offers, MIN(unit_price) AS low, MAX(unit_price) AS high, ROUND(AVG(unit_price), 4) AS mean, SUM(quantity) AS quantity, COUNT(DISTINCT tender_id) AS tenders
    FROM items WHERE unit_price > 0 GROUP BY 1, 2 ORDER BY offers DESC, name, unit LIMIT 50"""),
    "p29_term_aggregates": (lambda t: m.term_aggregates(_items(t), TERMS), """
    SELECT term, MIN(unit_price) AS low, MAX(unit_price) AS high, ROUND(AVG(unit_price), 4) AS mean, COUNT(DISTINCT tender_id) AS tenders
    FROM items JOIN (VALUES ('gear'), ('blue bolt'), ('small ring of'), ('red widget')) v(term) ON contains(lower(name), term) WHERE unit_price > 0 GROUP BY 1"""),
    "p35_similar_etenders": (lambda t: m.similar_etenders(_asked(t), t.tenders, t.items), _TRI + f"""
    , named AS (SELECT DISTINCT tender_id, name FROM items), lk AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT DISTINCT name, name FROM named),
    ql AS (SELECT DISTINCT q.tender_id AS qt, n.tender_id AS other FROM named q JOIN lk ON lk.a = q.name JOIN named n ON n.name = lk.b WHERE CAST(substr(q.tender_id, 2) AS BIGINT) % 100 = 0),
    sc AS (
      SELECT q.tender_id, t.tender_id AS other, t.closing_date, CASE WHEN q.procuring_entity = t.procuring_entity THEN 100 ELSE 0 END + CASE WHEN q.category = t.category THEN 50 ELSE 0 END + CASE WHEN ql.other IS NOT NULL THEN 30 ELSE 0 END AS score
      FROM (SELECT * FROM tenders WHERE {_ASKED}) q JOIN tenders t ON t.tender_id <> q.tender_id AND t.status IN ('awarded', 'closed') AND t.actual_value_mkd IS NOT NULL LEFT JOIN ql ON qt = q.tender_id AND ql.other = t.tender_id)
    SELECT * FROM (SELECT tender_id, other, score, CAST(row_number() OVER (PARTITION BY tender_id ORDER BY score DESC, closing_date DESC, other) AS INTEGER) AS place FROM sc WHERE score > 0) x WHERE place <= 10"""),
    "p50_open_matches": (_leads, """
    , best AS (SELECT * FROM (SELECT tender_id, substr(cpv_code, 1, 2) AS division, CAST(row_number() OVER (PARTITION BY substr(cpv_code, 1, 2) ORDER BY estimated_value_mkd DESC, tender_id) AS INTEGER) AS place
                              FROM tenders WHERE status = 'open' AND publication_date BETWEEN DATE '2001-08-01' - 900 AND DATE '2001-08-01') x WHERE place <= 5)
    SELECT c_custkey AS lead_id, tender_id, place FROM customer JOIN best ON c_custkey % 9 > 0 AND division = lpad(CAST(c_custkey % 50 + 1 AS VARCHAR), 2, '0')
    WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 5 <> 1 AND c_custkey % 7 <> 1 AND (c_custkey % 4 <> 0 OR c_custkey % 12 >= 7)"""),
    "p71_similar_awards": (lambda t: m.similar_awards(_asked(t), t.tenders), f"""
    , q AS (SELECT *, list_slice(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 3), 1, 3) AS words FROM tenders WHERE {_ASKED} AND estimated_value_mkd > 0),
    near AS (
      SELECT q.tender_id, COALESCE(NULLIF(a.actual_value_mkd, 0), a.estimated_value_mkd) AS price, row_number() OVER (PARTITION BY q.tender_id ORDER BY a.publication_date DESC, a.tender_id) AS place
      FROM q JOIN tenders a ON substr(a.cpv_code, 1, 4) = substr(q.cpv_code, 1, 4) AND a.status = 'awarded' AND a.tender_id <> q.tender_id AND a.estimated_value_mkd BETWEEN q.estimated_value_mkd * 0.5 AND q.estimated_value_mkd * 1.5
      WHERE len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(a.title), lower(w)))) > 0)
    SELECT tender_id, CAST(COUNT(*) AS INTEGER) AS found, MIN(price) AS low, ROUND(AVG(price), 4) AS mean, list_sort(list(price))[COUNT(*) // 2 + 1] AS upper_median, MAX(price) AS high FROM near WHERE place <= 20 GROUP BY 1"""),
    "x10_similar_specifications": (lambda t: _specifications(t, **_LEVELS), _PAIRS + """
    SELECT *, CASE WHEN NOT same_institution AND cosine >= 0.35 THEN 'clone' WHEN same_institution AND cosine >= 0.3 THEN 'reuse' ELSE 'template' END AS kind FROM pairs"""),
    "x11_cross_clones": (lambda t: _specifications(t, **_LEVELS).filter("not same_institution and cosine >= 0.35").select("n1", "n2", "institution_1", "institution_2", "cosine", "same_winner"), _PAIRS + """
    SELECT n1, n2, institution_1, institution_2, cosine, same_winner FROM pairs WHERE NOT same_institution AND cosine >= 0.35"""),
    "x12_institution_reuse": (lambda t: m.institution_reuse(_specifications(t, **_LEVELS), t.raw("embeddings"), t.tenders, least=0.25), _PAIRS + """
    , sp AS (SELECT procuring_entity, COUNT(*) AS n FROM tenders WHERE CAST(substr(tender_id, 2) AS BIGINT) IN (SELECT vec_id FROM embeddings) GROUP BY 1 HAVING COUNT(*) >= 2),
    re AS (SELECT institution_1, COUNT(*) AS r FROM pairs WHERE same_institution GROUP BY 1),
    tw AS (SELECT * FROM (SELECT procuring_entity AS pe, winner, COUNT(*) AS w, row_number() OVER (PARTITION BY procuring_entity ORDER BY COUNT(*) DESC, winner) AS place FROM tenders WHERE status IN ('awarded', 'completed') AND winner IS NOT NULL GROUP BY 1, 2) x WHERE place = 1)
    SELECT procuring_entity, n AS specifications, GREATEST(1, n - COALESCE(r, 0)) AS unique, ROUND(1 - GREATEST(1, n - COALESCE(r, 0)) / CAST(n AS DOUBLE), 4) AS reuse_rate, winner AS top_winner, ROUND(COALESCE(w, 0) * 100 / CAST(n AS DOUBLE), 2) AS top_percent
    FROM sp LEFT JOIN re ON institution_1 = procuring_entity LEFT JOIN tw ON pe = procuring_entity"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: DOMAIN_SQL + sql for name, (_, sql) in _ALL.items() if sql}
