"""Ingest: upserts with history, registry checks, status detection, child rows of JSON columns, exports, identity resolution."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.cleaning import normalized_company
from bidscope.workspace import fresh_path

#: Procedure names of the two sources -> the common name.
PROCEDURE_NAMES = {
    "NegotiatedProcedureWithoutPriorPublication": "negotiated",
    "LowEstimatedValueProcedure": "low value",
    "Open": "open",
    "QualificationSystem": "qualification",
    "SimplifiedOpenProcedure": "simplified open",
    "Отворена постапка": "open",
    "Поедноставена отворена постапка": "simplified open",
    "Набавка од мала вредност": "low value",
}
#: Words that tell a status, asked in this order.
STATUS_WORDS = (("cancelled", ("cancel", "поништ", "откаж")), ("awarded", ("award", "доделен")), ("closed", ("closed", "затворен")))


def upsert_with_history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All versions after the upsert: rows of ``old`` and ``new`` (same columns) with ``version`` and ``current``.

    A new null keeps the old value.  A row that changes stays as version 1, no longer current, before its version 2.
    """
    fields = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*fields).alias("a"))
    b = new.select(*keys, F.struct(*fields).alias("b"))
    j = a.join(b, keys, "full")
    merged = F.struct(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fields])
    row = lambda s, version, current: F.struct(s.alias("s"), F.lit(version).alias("version"), F.lit(current).alias("current"))
    same = F.col("b").isNull() | F.col("a").eqNullSafe(merged)
    versions = F.when(F.col("a").isNull(), F.array(row(F.col("b"), 1, True))).when(same, F.array(row(F.col("a"), 1, True)))
    versions = versions.otherwise(F.array(row(F.col("a"), 1, False), row(merged, 2, True)))
    return j.select(*keys, F.explode(versions).alias("v")).select(*keys, *[F.col(f"v.s.{c}").alias(c) for c in fields], "v.version", "v.current")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(old.columns))


def child_rows(df: DataFrame, keys: list[str], column: str, schema: str) -> DataFrame:
    """The objects of a JSON array column as typed rows; what can't be read gives none."""
    return df.select(*keys, F.explode(F.from_json(column, f"array<{schema}>")).alias("__c")).select(*keys, "__c.*")


def export_csv(df: DataFrame, order: list, most_rows: int) -> DataFrame:
    """The first rows in an order, written as CSV with a heading and read back."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "export")
    df.orderBy(*order).limit(most_rows).write.csv(path, header=True)
    return spark.read.schema(df.schema).csv(path, header=True)


def registry_issues(registration: Column, tax: Column) -> Column:
    """What is wrong with a registry row's numbers, as an array."""
    bad = lambda c, pattern, name: F.when(c.isNotNull() & ~c.rlike(pattern), name)
    return F.array_compact(F.array(bad(registration, r"^\d{5,8}$", "registration number"), bad(tax, r"^\d{10,15}$", "tax number")))


def run_statistics(changes: DataFrame) -> DataFrame:
    """One row of what a run found, from classified changes."""
    kinds = {k: F.count_if(F.col("change") == k).alias(k) for k in ("new", "updated", "unchanged")}
    return changes.agg(F.count(F.lit(1)).alias("found"), *kinds.values())


def detected_status(explicit: Column, winner: Column, closing: Column, text: Column, as_of: date, words=STATUS_WORDS) -> Column:
    """The stated status; else awarded if there is a winner, closed past the deadline, what the text says, open."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.coalesce(*[F.when(low.rlike("|".join(w)), status) for status, w in words])
    stated = F.when(F.trim(explicit) != "", F.lower(F.trim(explicit)))
    return F.coalesce(stated, F.when(F.trim(winner) != "", "awarded"), F.when(closing < F.lit(as_of), "closed"), said, F.lit("open"))


def procedure_name(name: Column) -> Column:
    """The common name of a procedure; the given one, in lower case, if it has none."""
    return F.coalesce(*[F.when(name == k, v) for k, v in PROCEDURE_NAMES.items()], F.lower(name))


def lasting_emails(mails: DataFrame, column: str, disposable: DataFrame) -> DataFrame:
    """Valid addresses whose domain is not among the disposable ones (domain)."""
    ok = mails.filter(F.col(column).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
    return ok.withColumn("domain", F.lower(F.split_part(column, F.lit("@"), F.lit(2)))).join(disposable.select("domain").distinct(), "domain", "left_anti")


def resolved_identities(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """(row_id, company_id, how): by source id, else registration number, tax number, normalized name.

    Both sides have (source_id, registration, tax, name); the least company_id of equal keys stands for them.
    """
    name = normalized_company(F.col("name"))
    left = incoming.select("row_id", "source_id", "registration", "tax", name.alias("name"))
    right = registry.select("company_id", "source_id", "registration", "tax", name.alias("name"))
    ways = ("source_id", "registration", "tax", "name")
    for way in ways:
        ids = right.filter(F.col(way).isNotNull() & (F.col(way).cast("string") != "")).groupBy(way).agg(F.min("company_id").alias(f"by_{way}"))
        left = left.join(ids, way, "left")
    how = F.coalesce(*[F.when(F.col(f"by_{w}").isNotNull(), w) for w in ways])
    return left.select("row_id", F.coalesce(*[F.col(f"by_{w}") for w in ways]).alias("company_id"), how.alias("how"))


def merged_contacts(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """(company_id, email, by): the least address of the same normalized name and city, else of the same name."""
    key = normalized_company(F.col("name"))
    own = companies.select("company_id", key.alias("k"), F.upper("city").alias("city"))
    mail = contacts.filter("email is not null").select(key.alias("k"), F.upper("city").alias("city"), "email")
    near = mail.filter("city is not null").groupBy("k", "city").agg(F.min("email").alias("near"))
    any_ = mail.groupBy("k").agg(F.min("email").alias("any"))
    j = own.join(near, ["k", "city"], "left").join(any_, "k", "left").filter("any is not null")
    return j.select("company_id", F.coalesce("near", "any").alias("email"), F.when(F.col("near").isNotNull(), "name and city").otherwise("name").alias("by"))


def address_classes(companies: DataFrame) -> DataFrame:
    """(company_id, class_id, related): companies of one normalized address form a class, named by its least id."""
    key = F.trim(F.regexp_replace(F.lower("address"), r"[^\p{L}\p{N}]+", " "))
    rows = companies.select("company_id", key.alias("address")).filter("address <> ''")
    groups = rows.groupBy("address").agg(F.min("company_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("related")).filter("related > 0")
    return rows.join(groups, "address").select("company_id", "class_id", "related")


def term_hits(items: DataFrame, terms: list[str]) -> DataFrame:
    """Items with each term of a short list that their names contain: every item is read once for all terms."""
    low = F.lower("name")
    found = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))
    return items.withColumn("term", F.explode(found))


def listed_awards(tenders: DataFrame, least: int) -> DataFrame:
    """(winner, category, awards, listed): awards of each company in the categories on its own list of frequent ones."""
    per = tenders.filter("winner is not null and category is not null").groupBy("winner", "category").agg(F.count(F.lit(1)).alias("n"))
    lists = per.filter(F.col("n") >= least).groupBy("winner").agg(F.collect_set("category").alias("categories"))
    each = lists.select("winner", F.explode("categories").alias("category"), F.size("categories").alias("listed"))
    return each.join(per, ["winner", "category"]).select("winner", "category", F.col("n").alias("awards"), "listed")


def yearly_wins(bidders: DataFrame, tenders: DataFrame) -> DataFrame:
    """Each company's bids with its wins of every year, and the share of its best year."""
    j = bidders.filter("is_winner").join(tenders.select("tender_id", F.year("publication_date").alias("year")), "tender_id")
    per = j.groupBy("company_name", "year").agg(F.count(F.lit(1)).alias("wins"), F.sum("bid_amount_mkd").alias("value"))
    w = Window.partitionBy("company_name")
    return per.select("company_name", "year", "wins", "value", F.round(F.max("wins").over(w) / F.sum("wins").over(w), 6).alias("best_share"))


def nested_winners(tenders: DataFrame, k: int = 3) -> DataFrame:
    """(procuring_entity, winners): the k companies with most awards of a buyer as JSON."""
    per = tenders.filter("winner is not null").groupBy("procuring_entity", "winner").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("procuring_entity").orderBy(F.desc("n"), "winner"))
    best = per.withColumn("place", place).filter(F.col("place") <= k)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", "winner", "n"))), lambda x: F.struct(x["winner"].alias("winner"), x["n"].alias("awards")))
    return best.groupBy("procuring_entity").agg(F.to_json(rows).alias("winners"))


def both_marketplaces(tenders: DataFrame, items: DataFrame) -> DataFrame:
    """Sums per year of tenders and of marketplace offers, tagged by source."""
    a = tenders.select(F.lit("tenders").alias("source"), F.year("publication_date").alias("year"), F.col("estimated_value_mkd").alias("value"))
    b = items.select(F.lit("marketplace").alias("source"), F.year("offered_on").alias("year"), (F.col("quantity") * F.col("unit_price")).alias("value"))
    return a.unionByName(b).groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
