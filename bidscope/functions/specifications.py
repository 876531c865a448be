"""Specifications read for brands, qualifications and complexity, and the chance that one was written for a single supplier.

Every measure is a column expression over one text: nothing is shuffled.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Brands, words in capitals that are no brands, patterns and limits of the rules.
BRANDS = [
    "HP", "DELL", "LENOVO", "APPLE", "SAMSUNG", "LG", "SONY", "ASUS", "ACER", "TOSHIBA", "FUJITSU", "CISCO", "JUNIPER", "HUAWEI", "ZTE",
    "MICROSOFT", "ORACLE", "SAP", "IBM", "INTEL", "AMD", "NVIDIA", "CANON", "EPSON", "BROTHER", "XEROX", "RICOH", "KONICA", "MINOLTA",
    "STEELCASE", "HERMAN MILLER", "IKEA",
    "MERCEDES", "BMW", "AUDI", "VOLKSWAGEN", "TOYOTA", "HYUNDAI", "KIA", "FORD", "OPEL", "RENAULT", "PEUGEOT", "CITROEN", "FIAT", "SKODA",
    "LAND ROVER", "VOLVO", "DACIA", "NISSAN", "MITSUBISHI", "SUZUKI",
    "SIEMENS", "PHILIPS", "GE HEALTHCARE", "MEDTRONIC", "ROCHE", "ABBOTT", "BECKMAN", "MINDRAY", "DRAEGER",
    "CATERPILLAR", "KOMATSU", "BOSCH", "MAKITA", "HILTI", "DEWALT", "ATLAS COPCO", "KARCHER", "STIHL",
]
NO_BRANDS = [
    "EUR", "ISO", "THE", "AND", "FOR", "PDF", "DOC", "XML", "HTML", "URL", "API", "RAM", "CPU", "GPU", "SSD", "HDD", "USB", "LED",
    "LCD", "LAN", "WAN", "VPN", "DNS", "TCP", "UDP", "HTTP", "HTTPS", "FTP", "SSH", "SQL", "LOT",
]
CAPITALS = r"\b([A-Z][A-Z0-9]{2,})\b"
EQUIVALENT = r"(?:или\s+еквивалент(?:ен|но|на|ни)?|or\s+equivalent)"
QUOTED = r'["“„]([^"”‟]{3,60})["”‟]'
PART_NUMBER = r"(?:P/?N|Part\s*No\.?|Кат\.?\s*бр\.?|Арт\.?\s*бр\.?)\s*:?\s*([A-Za-z0-9\-]{3,20})"
MODEL = r"\b([A-Za-z]{1,10}[\-\s]?[0-9]{2,6}[A-Za-z0-9\-]*)\b"
#: Kind -> (pattern over the lower-cased text, value above which it is excessive).
QUALIFICATIONS = {
    "turnover": (r"промет\s+(?:од\s+)?(\d[\d.,]{2,15})", 50_000_000),
    "financial_threshold": (r"(\d[\d.,]{2,15})\s*(?:денар[иа]?|ден\.?|мкд|mkd)", 100_000_000),
    "experience_years": (r"(\d+)\s*(?:годин[аиe]\s*(?:искуств[оа]|работно)|год\.?\s*(?:искуств[оа]|работно)|years?\s*(?:of\s+)?experience)", 10),
    "certification": (r"iso\s*(\d{4,5})", None),
    "employees": (r"(?:минимум|најмалку|барем)\s*(\d+)\s*(?:вработен[иа]|лиц[аеи]|работниц[иа])", 50),
    "license": (r"(?:лиценца|дозвола|одобрение|сертификат|овластување)\s+(?:за|од)\s+(.{5,80}?)[.;,\n]", None),
    "guarantee": (r"гаранција\s+(?:од|во\s+износ\s+од)\s+(\d[\d.,]{2,15})", 10_000_000),
}
#: Of money that is named at all, what is taken for a threshold.
LEAST_MONEY = 1_000_000
#: Mean and deviation of usual specifications.
SENTENCE, WORD, VARIETY = (18.5, 6.2), (6.8, 1.4), (0.42, 0.12)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def brands(text: Column) -> Column:
    """Array of (brand, confidence, kind), each brand once, by the first of the rules that finds it.

    Rules in order: known names, words in capitals, names before a trade mark, names before "or equivalent", part
    numbers, model numbers (the first ten, of texts with twenty at most).
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda names, confidence, kind: F.transform(names, lambda n: F.struct(F.trim(n).alias("brand"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind")))
    names = F.split(F.lit("|".join(BRANDS)), "[|]")
    known = F.flatten(F.transform(F.array(F.lower(text)), lambda low: F.filter(names, lambda b: F.contains(low, F.lower(b)))))
    capitals = F.filter(_all(text, CAPITALS), lambda w: ~w.isin(NO_BRANDS))
    marked = F.split(F.translate(text, "™©", "®®"), "®")
    heads = F.slice(marked, 1, F.size(marked) - 1)
    last_words = F.transform(heads, lambda h: F.array_join(F.slice(F.reverse(F.split(F.trim(F.right(h, F.lit(40))), r"\s+")), 1, 2), " "))
    turned = F.transform(last_words, lambda p: F.array_join(F.reverse(F.split(p, " ")), " "))
    parts = F.split(text, f"(?iu){EQUIVALENT}")
    before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.right(p, F.lit(100)))
    named = F.transform(before, lambda p: F.struct(F.try_element_at(_all(p, CAPITALS), F.lit(-1)).alias("c"), F.try_element_at(_all(p, QUOTED), F.lit(-1)).alias("q")))
    equal = F.transform(F.filter(named, lambda n: n["c"].isNotNull() | n["q"].isNotNull()), lambda n: F.struct(F.trim(F.coalesce(n["c"], n["q"])).alias("brand"), F.when(n["c"].isNotNull(), 0.85).otherwise(0.8).alias("confidence"), F.lit("or_equivalent").alias("kind")))
    models = _all(text, MODEL)
    some = F.filter(F.slice(F.when(F.size(models) <= 20, models).otherwise(F.array().cast("array<string>")), 1, 10), lambda m: F.length(m) >= 3)
    rules = F.concat(found(known, 0.9, "known_brand"), found(capitals, 0.5, "capitals"), found(turned, 0.95, "trademark"), equal, found(_all(text, f"(?iu){PART_NUMBER}"), 0.7, "part_number"), found(some, 0.4, "model_number"))
    none = F.array().cast("array<struct<brand:string,confidence:double,kind:string>>")
    seen = lambda kept, r: F.exists(kept, lambda k: F.lower(k["brand"]) == F.lower(r["brand"]))
    return F.aggregate(rules, none, lambda kept, r: F.when((F.length(r["brand"]) < 2) | seen(kept, r), kept).otherwise(F.concat(kept, F.array(r))))


def qualifications(text: Column) -> Column:
    """Array of (kind, value, excessive).  Three certificates or more are excessive together."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def of(kind: str, pattern: str, most: int | None) -> Column:
        number = lambda v: F.regexp_replace(v, "[.,]", "").cast("double")
        over = (lambda v: F.lit(False)) if most is None else (lambda v: F.coalesce(number(v) > most, F.lit(False)))
        hits = _all(low, pattern)
        if kind == "financial_threshold":
            hits = F.filter(hits, lambda v: number(v) > LEAST_MONEY)
        if kind == "certification":
            over = lambda v: F.size(hits) >= 3
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value"), over(v).alias("excessive")))

    return F.concat(*[of(k, p, m) for k, (p, m) in QUALIFICATIONS.items()])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def with_complexity(docs: DataFrame) -> DataFrame:
    """Adds mean_sentence, mean_word, variety (over windows of 500 words in texts of over 1000), technical, complexity (0 to 1)."""
    text = F.coalesce("text", F.lit(""))
    sentences = F.filter(F.split(text, r"[.!?;]\s+"), lambda s: F.length(F.trim(s)) > 5)
    d = docs.withColumn("__w", words(F.col("text")))
    n = F.size("__w")
    lengths = F.filter(F.transform(sentences, lambda s: F.size(words(s)).cast("double")), lambda x: x > 0)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(5000))), F.lit(500)), lambda i: F.slice("__w", i, 500))
    shares = F.transform(F.filter(windows, lambda w: F.size(w) >= 100), lambda w: F.size(F.array_distinct(w)) / F.size(w))
    plain = F.try_divide(F.size(F.array_distinct("__w")), n)
    technical = F.size(F.filter("__w", lambda w: (F.length(w) > 10) | w.rlike(r"\d"))) / n
    d = d.withColumns({"__s": F.coalesce(_mean(lengths), F.lit(0.0)), "__l": _mean(F.transform("__w", lambda w: F.length(w).cast("double"))), "__v": F.when(n > 1000, _mean(shares)).otherwise(plain), "__t": technical})
    empty = (F.length(F.trim(text)) < 20) | (F.size(sentences) == 0) | (n == 0)
    far = lambda c, usual: F.abs(F.col(c) - usual[0]) / usual[1]
    score = F.least(F.lit(1.0), (far("__s", SENTENCE) + far("__l", WORD) + far("__v", VARIETY)) / 9)
    shown = {"mean_sentence": (F.col("__s"), 0.0, 2), "mean_word": (F.col("__l"), 0.0, 2), "variety": (F.col("__v"), 0.0, 4), "technical": (F.col("__t"), 0.0, 4), "complexity": (score, 0.5, 4)}
    return d.withColumns({k: F.when(empty, other).otherwise(F.round(v, places)) for k, (v, other, places) in shown.items()}).drop("__w", "__s", "__l", "__v", "__t")


def assessed(docs: DataFrame) -> DataFrame:
    """(doc_id, brands, exclusivity, qualifications, restrictiveness, complexity, factors, probability) of rows (doc_id, text)."""
    one = lambda x: F.least(F.lit(1.0), x)
    size = lambda c, kind: F.size(F.filter(c, lambda b: b["kind"] == kind))
    d = with_complexity(docs.select("doc_id", "text")).withColumns({"b": brands(F.col("text")), "q": qualifications(F.col("text")), "n_words": F.size(words(F.col("text")))})
    n, confidence = F.size("b"), _mean(F.transform("b", lambda b: b["confidence"]))
    raw = 0.4 * one(n / 5) + 0.4 * confidence + 0.2 * one(n / F.greatest("n_words", F.lit(1)) * 100)
    raw = F.when(F.coalesce("text", F.lit("")).rlike(f"(?iu){EQUIVALENT}"), raw * 0.8).otherwise(raw)
    exclusivity = F.when(n == 0, 0.0).otherwise(F.when(size("b", "known_brand") >= 2, one(raw * 1.3)).otherwise(one(raw)))
    over = F.filter("q", lambda x: x["excessive"])
    kinds = F.size(F.array_distinct(F.transform("q", lambda x: x["kind"])))
    restrictive = F.when(F.size("q") == 0, 0.0).otherwise(0.3 * one(F.size("q") / 8) + 0.5 * one(F.size(over) / 3) + 0.2 * one(kinds / 5))
    d = d.withColumns({"exclusivity": exclusivity, "restrictiveness": restrictive})
    named = F.size(F.filter(F.slice(over, 1, 3), lambda x: ~x["kind"].isin("certification", "license")))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    long = F.col("mean_sentence") > 0
    factors = sum((yes(size("b", k) > 0) for k in ("known_brand", "trademark", "or_equivalent", "part_number")), named)
    factors = factors + yes(F.col("exclusivity") > 0.7) + yes(size("q", "certification") >= 3) + yes(F.col("restrictiveness") > 0.6)
    factors = factors + yes((F.col("complexity") > 0.6) | ((F.col("complexity") < 0.15) & long)) + yes((F.col("variety") < 0.2) & long)
    chance = 0.35 * F.col("exclusivity") + 0.3 * F.col("restrictiveness") + 0.15 * F.col("complexity") + 0.2 * one(factors / 6)
    return d.select("doc_id", n.alias("brands"), F.round("exclusivity", 6).alias("exclusivity"), F.size("q").alias("qualifications"), F.round("restrictiveness", 6).alias("restrictiveness"), "complexity", factors.alias("factors"), F.round(one(chance), 6).alias("probability"))
