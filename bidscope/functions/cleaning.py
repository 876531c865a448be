"""Cleaning as column expressions: dates, numbers, names, scripts, codes, hashes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Macedonian month names.
MONTHS = ("јануари", "февруари", "март", "април", "мај", "јуни", "јули", "август", "септември", "октомври", "ноември", "декември")
#: Latin digraphs, then single letters, with their Macedonian Cyrillic forms.
DIGRAPHS = (("dzh", "џ"), ("gj", "ѓ"), ("kj", "ќ"), ("lj", "љ"), ("nj", "њ"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("dz", "ѕ"))
LATIN, CYRILLIC = "abvgdezijklmnoprstufhc", "абвгдезијклмнопрстуфхц"
DATE_FORMATS = ("dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")


#: Names of the divisions of category codes.
CPV_DIVISIONS = {
    "03": "Agricultural products",
    "09": "Petroleum products, fuel",
    "14": "Mining products",
    "15": "Food, beverages, tobacco",
    "16": "Agricultural machinery",
    "18": "Clothing, footwear",
    "19": "Leather products",
    "22": "Printed matter",
    "24": "Chemical products",
    "30": "Office machinery, computers",
    "31": "Electrical machinery",
    "32": "Radio, television, communication",
    "33": "Medical equipment",
    "34": "Transport equipment",
    "35": "Security, fire-fighting",
    "37": "Musical instruments, sports",
    "38": "Laboratory equipment",
    "39": "Furniture",
    "41": "Collected water",
    "42": "Industrial machinery",
    "43": "Machinery for mining",
    "44": "Construction structures",
    "45": "Construction work",
    "48": "Software packages",
    "50": "Repair and maintenance",
    "51": "Installation services",
    "55": "Hotel and restaurant services",
    "60": "Transport services",
    "63": "Supporting transport services",
    "64": "Postal and telecommunications",
    "65": "Public utilities",
    "66": "Financial services",
    "70": "Real estate services",
    "71": "Architectural services",
    "72": "IT services",
    "73": "Research services",
    "75": "Administration services",
    "76": "Oil and gas services",
    "77": "Agricultural services",
    "79": "Business services",
    "80": "Education services",
    "85": "Health and social services",
    "90": "Sewage, refuse services",
    "92": "Recreational services",
    "98": "Other community services",
}


def parse_date(text: Column, as_of: date, low: int = 2000, high: int = 2050) -> Column:
    """A date in one of several formats, with a Macedonian month name, or as today/yesterday; null outside the years ``low`` to ``high`` or if none fits."""
    t = F.lower(F.trim(text))
    named = t
    for n, month in enumerate(MONTHS, 1):
        named = F.regexp_replace(named, rf"\s+{month}\s+", f".{n:02d}.")
    named = F.regexp_replace(named, r"^(\d)\.", "0$1.")
    tried = [F.try_to_timestamp(named, F.lit(f)).cast("date") for f in DATE_FORMATS]
    day = F.coalesce(F.when(t.isin("denes", "денес", "today"), F.lit(as_of)).when(t.isin("vcera", "вчера", "yesterday"), F.date_sub(F.lit(as_of), 1)), *tried)
    return plausible(day, low, high)


def plausible(day: Column, low: int = 2000, high: int = 2050) -> Column:
    return F.when(F.year(day).between(low, high), day)


def parse_amount(text: Column) -> Column:
    """A number with European or American separators; of a range the first; null above 10^10 or if there is none."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d[\d.,\s]*\d|\d)", 1)
    s = F.regexp_replace(first, r"\s", "")
    dot, comma = F.length(s) - F.length(F.substring_index(s, ".", -1)), F.length(s) - F.length(F.substring_index(s, ",", -1))
    european = comma > dot
    only_comma = (comma > 0) & (dot == 0)
    thousands = only_comma & s.rlike(r"^\d{1,3}(,\d{3})+$")
    plain = F.when(thousands, F.regexp_replace(s, ",", "")).when(european, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).when(s.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.regexp_replace(s, r"\.", "")).otherwise(F.regexp_replace(s, ",", ""))
    value = plain.try_cast("double")
    return F.when(value <= 1e10, value)


def transliterate(text: Column) -> Column:
    """Latin to Macedonian Cyrillic in lower case, digraphs first."""
    out = F.lower(text)
    for latin, cyrillic in DIGRAPHS:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    return F.translate(out, LATIN, CYRILLIC)


def search_variants(term: Column) -> Column:
    """The term, and its Cyrillic form unless it has Cyrillic letters already."""
    return F.when(term.rlike("[Ѐ-ӿ]"), F.array(term)).otherwise(F.array_distinct(F.array(term, transliterate(term))))


def normalized_company(name: Column) -> Column:
    """Upper case without legal forms, punctuation and double spaces."""
    out = F.upper(F.trim(name))
    out = F.regexp_replace(out, r"[\"'„“”.,()\-#]", " ")
    out = F.regexp_replace(out, r"\b(ДООЕЛ|ДОО|АД|ТП|DOOEL|DOO|AD|LTD|LLC|INC)\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def cpv_level(code: Column) -> Column:
    digits = F.length(F.rtrim(F.lit("0"), F.regexp_replace(code, "-.*$", "")))
    return F.when(digits <= 2, "division").when(digits == 3, "group").when(digits == 4, "class").otherwise("category")


def cpv_parent(code: Column) -> Column:
    return F.concat(F.substring(code, 1, 2), F.lit("000000"))


def cpv_name(code: Column) -> Column:
    """The name of a code's division; null if there is none."""
    names = F.create_map(*[F.lit(part) for pair in CPV_DIVISIONS.items() for part in pair])
    return F.try_element_at(names, F.substring(code, 1, 2))


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of field:value pairs joined by a bar; null fields are left out."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in fields.items()]), 256)


def valid_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def good_product(name: Column, strict: bool = False) -> Column:
    """A product name worth showing: of some length, with letters, no table heading."""
    ok = (F.length(F.trim(name)) >= (10 if strict else 5)) & name.rlike("[A-Za-zЀ-ӿ]") & ~F.lower(name).rlike(r"^(вкупно|total|ред\.? ?бр|no\.?)\b")
    return F.coalesce(ok, F.lit(False))


def validate_tenders(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows): no id rejects; a short title falls back to description, buyer, id; bad values become null and are named in ``issues``."""
    title = F.coalesce(*[F.when(F.length(F.trim(c)) >= 3, F.trim(c)) for c in (F.col("title"), F.col("description"), F.col("procuring_entity"))], F.concat(F.lit("Tender "), "tender_id"))
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim("title")) < 3, F.lit(True)), "title"), F.when(F.col("estimated_value_mkd") < 0, "negative value"), F.when(F.col("estimated_value_mkd") > 1e9, "very large value"), F.when(F.col("closing_date") < F.col("publication_date"), "dates out of order")
    ))
    has_id = F.coalesce(F.trim("tender_id") != "", F.lit(False))
    good = raw.filter(has_id).withColumns({"issues": issues, "title": title, "estimated_value_mkd": F.when(F.col("estimated_value_mkd") >= 0, F.col("estimated_value_mkd"))})
    return good, raw.filter(~has_id)


def classify_changes(old: DataFrame, new: DataFrame, key: str = "tender_id") -> DataFrame:
    """new rows as new, updated or unchanged against the hashes of an older snapshot; a missing old hash means updated."""
    before = old.select(key, F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"), F.col("scrape_count").alias("old_count"))
    kind = F.when(F.col("known").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("old_hash").isNotNull(), "unchanged").otherwise("updated")
    return new.join(before, key, "left").select(*new.columns, kind.alias("change"), (F.coalesce("old_count", F.lit(0)) + 1).alias("scrape_count"))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: the new value where there is one, else the old."""
    others = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in others])
