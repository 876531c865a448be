"""Open-contracting (OCDS) JSON releases to tender, bidder and lot rows; JSON columns; repairs from later releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EUR_TO_MKD = 61.5
_VALUE = "struct<amount:double,currency:string>"
#: What is read of a release; other fields are skipped by the parser.
RELEASE_SCHEMA = f"""ocid string, date string,
buyer struct<name:string>,
tender struct<title:string,description:string,value:{_VALUE},procurementMethodDetails:string,tenderPeriod:struct<startDate:string,endDate:string>,items:array<struct<classification:struct<id:string>>>,lots:array<struct<id:string,title:string,value:{_VALUE}>>>,
awards array<struct<value:{_VALUE},suppliers:array<struct<name:string>>>>,
contracts array<struct<value:{_VALUE}>>,
bids struct<details:array<struct<value:{_VALUE},tenderers:array<struct<name:string>>,relatedLots:array<string>>>>"""


def in_mkd(value: Column) -> Column:
    """A value's amount in MKD; null without an amount."""
    return value["amount"] * F.when(value["currency"] == "EUR", EUR_TO_MKD).otherwise(1.0)


def ocid_uuid(ocid: Column) -> Column:
    found = F.regexp_extract(ocid, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1)
    return F.when(found != "", found)


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASE_SCHEMA).json(path)


def _suppliers() -> Column:
    each = F.transform(F.coalesce("awards", F.array().cast("array<struct<value:struct<amount:double,currency:string>,suppliers:array<struct<name:string>>>>")), lambda a: F.coalesce(F.transform(a["suppliers"], lambda s: s["name"]), F.array().cast("array<string>")))
    return F.filter(F.flatten(each), lambda n: n.isNotNull())


def tenders(releases: DataFrame) -> DataFrame:
    """One row per release: highest award value, first supplier as winner, first category code."""
    codes = F.filter(F.transform("tender.items", lambda i: i["classification"]["id"]), lambda c: c.isNotNull())
    day = lambda c: F.try_to_timestamp(c).cast("date")
    return releases.withColumn("winners", _suppliers()).select(
        "ocid", ocid_uuid(F.col("ocid")).alias("uuid"), F.col("tender.title").alias("title"), F.col("tender.description").alias("description"), F.col("buyer.name").alias("procuring_entity"),
        in_mkd(F.col("tender.value")).alias("estimated_value_mkd"), F.array_max(F.transform("awards", lambda a: in_mkd(a["value"]))).alias("actual_value_mkd"), F.get("winners", F.lit(0)).alias("winner"), F.get(codes, F.lit(0)).alias("cpv_code"),
        day(F.col("tender.tenderPeriod.endDate")).alias("closing_date"), day(F.col("date")).alias("publication_date"), F.col("tender.procurementMethodDetails").alias("procedure_type"), (F.coalesce(F.size("tender.lots"), F.lit(0)) > 1).alias("has_lots"),
    )


def bidders(releases: DataFrame) -> DataFrame:
    """One row per tenderer of each bid; where a release has no bids, per supplier of each award."""
    base = releases.withColumn("winners", _suppliers())
    bid = base.select("ocid", "winners", F.explode("bids.details").alias("b")).select("ocid", "winners", in_mkd(F.col("b.value")).alias("bid_amount_mkd"), F.get("b.relatedLots", F.lit(0)).alias("lot_id"), F.explode("b.tenderers.name").alias("company_name"))
    own = bid.filter("company_name is not null").select("ocid", "company_name", "bid_amount_mkd", F.array_contains("winners", F.col("company_name")).alias("is_winner"), "lot_id")
    without = base.join(own.select("ocid").distinct(), "ocid", "left_anti")
    awarded = without.select("ocid", F.explode("awards").alias("a")).select("ocid", F.explode("a.suppliers.name").alias("company_name"), in_mkd(F.col("a.value")).alias("bid_amount_mkd")).filter("company_name is not null")
    return own.unionByName(awarded.select("ocid", "company_name", "bid_amount_mkd", F.lit(True).alias("is_winner"), F.lit(None).cast("string").alias("lot_id")))


def lots(releases: DataFrame) -> DataFrame:
    return releases.select("ocid", F.posexplode("tender.lots").alias("pos", "l")).select("ocid", "pos", F.col("l.id").alias("lot_number"), F.col("l.title").alias("lot_title"), in_mkd(F.col("l.value")).alias("estimated_value_mkd"))


def repaired_values(stored: DataFrame, releases: DataFrame) -> DataFrame:
    """Stored rows whose actual value is missing take it from later releases: award values, then contract values."""
    later = releases.select("ocid", F.coalesce(F.array_max(F.transform("awards", lambda a: in_mkd(a["value"]))), F.array_max(F.transform("contracts", lambda a: in_mkd(a["value"])))).alias("found")).groupBy("ocid").agg(F.max("found").alias("found"))
    return stored.join(later, "ocid", "left").withColumn("actual_value_mkd", F.coalesce("actual_value_mkd", "found")).drop("found")


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: the schema that all values of a JSON column share, and how many can't be read."""
    parsed = F.try_parse_json(column)
    return df.agg(F.schema_of_variant_agg(parsed).alias("schema"), F.count(column).alias("rows"), F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("unreadable"))


def from_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders and their lines as release JSON, one text per order: what an import would have been given."""
    bids = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("r")))).alias("b"))
    money = lambda p, odd: F.struct(p.alias("amount"), F.when(odd, "EUR").otherwise("MKD").alias("currency"))
    release = F.struct(
        F.concat(F.lit("ocds-70d2nz-00000000-0000-4000-8000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("ocid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct(F.concat(F.lit("Buyer "), F.col("o_custkey")).alias("name")).alias("buyer"),
        F.struct(F.col("o_orderpriority").alias("title"), money(F.col("o_totalprice"), F.col("o_orderkey") % 2 == 1).alias("value")).alias("tender"),
        F.transform(F.filter("b", lambda x: x["r"] == "A"), lambda x: F.struct(money(x["p"], x["n"] % 2 == 1).alias("value"), F.array(F.struct(F.concat(F.lit("S"), x["s"].cast("string")).alias("name"))).alias("suppliers"))).alias("awards"),
        F.struct(F.transform(F.filter("b", lambda x: F.col("o_orderkey") % 3 != 0), lambda x: F.struct(money(x["p"], x["n"] % 2 == 1).alias("value"), F.array(F.struct(F.concat(F.lit("S"), x["s"].cast("string")).alias("name"))).alias("tenderers"))).alias("details")).alias("bids"),
    )
    return orders.join(bids, F.col("o_orderkey") == F.col("l_orderkey")).select(F.to_json(release).alias("json"))
