"""Registered queries over specifications, each with its SQL.  A specification is composed from each order's own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.functions import specifications as s

#: The text of an order's specification, as an expression that both engines read.
TEXT = """concat(
  'Набавка на опрема за ', o_orderpriority, ' со следниве услови: ',
  CASE o_orderkey % 6 WHEN 0 THEN 'DELL Latitude 5440 или еквивалент' WHEN 1 THEN 'CANON и EPSON со P/N: AB-1234' WHEN 2 THEN 'Acme Turbo® уред' WHEN 3 THEN 'USB or equivalent' WHEN 4 THEN '"Silent Master" or equivalent' ELSE 'опрема по избор' END, '. ',
  CASE WHEN o_orderkey % 4 = 0 THEN concat('Годишен промет од ', CAST(o_orderkey * 977 % 90000000 AS STRING), ' мкд за секоја година. ') ELSE '' END,
  CASE WHEN o_orderkey % 5 < 2 THEN concat('Се бара минимум ', CAST(o_orderkey % 17 AS STRING), ' години искуство; најмалку ', CAST(o_orderkey % 90 AS STRING), ' вработени. ') ELSE '' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Важат ISO 9001, ISO 14001 и ISO 27001. ' WHEN o_orderkey % 7 = 1 THEN 'Важи ISO 9001. ' ELSE '' END,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('Банкарска гаранција од ', CAST(o_orderkey * 991 % 30000000 AS STRING), ' за понудата. ') ELSE '' END,
  CASE WHEN o_orderkey % 8 = 3 THEN 'Потребна е дозвола за вршење дејност, со важност. ' ELSE '' END,
  repeat('Материјалот се доставува во рок и на место. ', CAST(o_orderkey % 3 AS INT)))"""


def _specs(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(TEXT).alias("text"))


def _listed(kind, array):
    return lambda t: _specs(t).select("doc_id", F.explode(array(F.col("text"))).alias("x")).select("doc_id", "x.*")


_quoted = lambda v: "'" + v.replace("'", "''") + "'"
_NAMES = "(VALUES " + ", ".join(f"({n}, '{b}')" for n, b in enumerate(s.BRANDS)) + ") v(n, brand)"
_NO = ", ".join(f"'{w}'" for w in s.NO_BRANDS)
_CAPS = f"regexp_extract_all(text, {_quoted(s.CAPITALS)}, 1)"
_MODELS = f"regexp_extract_all(text, {_quoted(s.MODEL)}, 1)"
_SPLIT = f"regexp_split_to_array(text, {_quoted('(?i)' + s.EQUIVALENT)})"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _each(values):
    return f"SELECT doc_id, text, unnest({values}) AS v, generate_subscripts({values}, 1) AS n FROM specs"


def _qualified(kind, pattern, most):
    number = "TRY_CAST(replace(replace(v, '.', ''), ',', '') AS DOUBLE)"
    over = "COUNT(*) OVER (PARTITION BY doc_id) >= 3" if kind == "certification" else "FALSE" if most is None else f"COALESCE({number} > {most}, FALSE)"
    values = f"regexp_extract_all(lower(text), {_quoted(pattern)}, 1)"
    keep = f" WHERE {number} > {s.LEAST_MONEY}" if kind == "financial_threshold" else ""
    return f"SELECT doc_id, '{kind}' AS kind, trim(v) AS value, {over} AS excessive, n FROM ({_each(values)}) x{keep}"


_BASE = f"""
WITH specs AS (SELECT o_orderkey AS doc_id, {TEXT} AS text FROM orders),
before0 AS (SELECT doc_id, right(v, 100) AS text, n FROM ({_each(_SPLIT)}) x JOIN (SELECT doc_id AS d, len({_SPLIT}) AS parts FROM specs) c ON d = doc_id WHERE n < parts),
rules AS (
  SELECT doc_id, brand, 0.9 AS confidence, 'known_brand' AS kind, 1 AS rule, n FROM specs, {_NAMES} WHERE contains(lower(text), lower(brand))
  UNION ALL SELECT doc_id, v, 0.5, 'capitals', 2, n FROM ({_each(_CAPS)}) x WHERE v NOT IN ({_NO})
  UNION ALL SELECT doc_id, regexp_extract(trim(right(split_part(text, '®', 1), 40)), '(\\S+\\s+)?\\S+$'), 0.95, 'trademark', 3, 1 FROM specs WHERE contains(text, '®')
  UNION ALL SELECT doc_id, COALESCE(c, q), CASE WHEN c IS NULL THEN 0.8 ELSE 0.85 END, 'or_equivalent', 4, n
            FROM (SELECT doc_id, n, list_extract({_CAPS}, -1) AS c, list_extract(regexp_extract_all(text, {_quoted(s.QUOTED)}, 1), -1) AS q FROM before0) x WHERE COALESCE(c, q) IS NOT NULL
  UNION ALL SELECT doc_id, v, 0.7, 'part_number', 5, n FROM ({_each(f"regexp_extract_all(text, {_quoted('(?i)' + s.PART_NUMBER)}, 1)")}) x
  UNION ALL SELECT doc_id, v, 0.4, 'model_number', 6, n FROM ({_each(_MODELS)}) x WHERE n <= 10 AND len({_MODELS}) <= 20 AND length(v) >= 3),
brands AS (
  SELECT doc_id, brand, CAST(confidence AS DOUBLE) AS confidence, kind
  FROM (SELECT doc_id, trim(brand) AS brand, confidence, kind, row_number() OVER (PARTITION BY doc_id, lower(trim(brand)) ORDER BY rule, n) AS place FROM rules WHERE length(trim(brand)) >= 2) x WHERE place = 1),
quals AS ({" UNION ALL ".join(_qualified(k, p, m) for k, (p, m) in s.QUALIFICATIONS.items())}),
sentences AS (SELECT doc_id, AVG(k) AS mean_sentence FROM (SELECT doc_id, len({_WORDS}) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?;]\\s+')) AS text FROM specs) x WHERE length(trim(text)) > 5) y WHERE k > 0 GROUP BY 1),
vocabulary AS (
  SELECT doc_id, COUNT(*) AS n_words, AVG(length(w)) AS mean_word, COUNT(DISTINCT w) / CAST(COUNT(*) AS DOUBLE) AS variety, COUNT(*) FILTER (WHERE length(w) > 10 OR regexp_matches(w, '\\d')) / CAST(COUNT(*) AS DOUBLE) AS technical
  FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM specs) x GROUP BY 1),
complex AS (
  SELECT doc_id, n_words, ROUND(mean_sentence, 2) AS mean_sentence, ROUND(mean_word, 2) AS mean_word, ROUND(variety, 4) AS variety, ROUND(technical, 4) AS technical,
         ROUND(LEAST(1.0, (ABS(mean_sentence - 18.5) / CAST(6.2 AS DOUBLE) + ABS(mean_word - 6.8) / CAST(1.4 AS DOUBLE) + ABS(variety - 0.42) / CAST(0.12 AS DOUBLE)) / 9), 4) AS complexity
  FROM sentences JOIN vocabulary USING (doc_id))
"""

_ALL = {
    "x18_brands": (_listed("brand", s.brands), "SELECT doc_id, brand, confidence, kind FROM brands"),
    "x19_qualifications": (_listed("qualification", s.qualifications), "SELECT doc_id, kind, value, excessive FROM quals"),
    "x20_specification_complexity": (lambda t: s.with_complexity(_specs(t)).drop("text"), "SELECT doc_id, mean_sentence, mean_word, variety, technical, complexity FROM complex"),
    "x21_rigging": (lambda t: s.assessed(_specs(t)), f"""
, bq AS (SELECT doc_id, COUNT(*) AS n, AVG(confidence) AS c, COUNT(*) FILTER (WHERE kind = 'known_brand') AS known, COUNT(*) FILTER (WHERE kind = 'trademark') AS marks, COUNT(*) FILTER (WHERE kind = 'or_equivalent') AS equal,
                COUNT(*) FILTER (WHERE kind = 'part_number') AS parts FROM brands GROUP BY 1),
kinds AS (SELECT unnest({list(s.QUALIFICATIONS)}) AS kind, generate_subscripts({list(s.QUALIFICATIONS)}, 1) AS turn),
placed AS (SELECT q.*, row_number() OVER (PARTITION BY doc_id, excessive ORDER BY turn, n) AS place FROM quals q JOIN kinds USING (kind)),
qq AS (SELECT doc_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE excessive) AS over, COUNT(DISTINCT kind) AS kinds, COUNT(*) FILTER (WHERE kind = 'certification') AS certificates,
              COUNT(*) FILTER (WHERE excessive AND place <= 3 AND kind NOT IN ('certification', 'license')) AS named FROM placed GROUP BY 1),
j AS (
  SELECT s.doc_id, COALESCE(b.n, 0) AS brands, COALESCE(q.n, 0) AS qualifications, complexity, mean_sentence, variety, known, marks, equal, parts, COALESCE(named, 0) AS named, COALESCE(certificates, 0) AS certificates,
         (0.4 * LEAST(1.0, b.n / CAST(5 AS DOUBLE)) + 0.4 * c + 0.2 * LEAST(1.0, b.n / CAST(n_words AS DOUBLE) * 100)) * CASE WHEN regexp_matches(text, {_quoted('(?i)' + s.EQUIVALENT)}) THEN CAST(0.8 AS DOUBLE) ELSE 1 END AS raw,
         CASE WHEN q.n IS NULL THEN 0 ELSE 0.3 * LEAST(1.0, q.n / CAST(8 AS DOUBLE)) + 0.5 * LEAST(1.0, over / CAST(3 AS DOUBLE)) + 0.2 * LEAST(1.0, kinds / CAST(5 AS DOUBLE)) END AS restrictiveness
  FROM specs s JOIN complex USING (doc_id) LEFT JOIN bq b USING (doc_id) LEFT JOIN qq q USING (doc_id)),
e AS (SELECT *, CASE WHEN raw IS NULL THEN 0 ELSE LEAST(1.0, CASE WHEN known >= 2 THEN raw * CAST(1.3 AS DOUBLE) ELSE raw END) END AS exclusivity FROM j),
f AS (
  SELECT *, CAST(COALESCE(known > 0, FALSE) AS INTEGER) + CAST(COALESCE(marks > 0, FALSE) AS INTEGER) + CAST(COALESCE(equal > 0, FALSE) AS INTEGER) + CAST(COALESCE(parts > 0, FALSE) AS INTEGER) + named
            + CAST(exclusivity > 0.7 AS INTEGER) + CAST(certificates >= 3 AS INTEGER) + CAST(restrictiveness > 0.6 AS INTEGER) + CAST(complexity > 0.6 OR complexity < 0.15 AS INTEGER) + CAST(variety < 0.2 AS INTEGER) AS factors FROM e)
SELECT doc_id, brands, ROUND(exclusivity, 6) AS exclusivity, qualifications, ROUND(restrictiveness, 6) AS restrictiveness, complexity, factors,
       ROUND(LEAST(1.0, CAST(0.35 AS DOUBLE) * exclusivity + CAST(0.3 AS DOUBLE) * restrictiveness + CAST(0.15 AS DOUBLE) * complexity + CAST(0.2 AS DOUBLE) * LEAST(1.0, factors / CAST(6 AS DOUBLE))), 6) AS probability FROM f"""),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: _BASE + sql for name, (_, sql) in _ALL.items()}
