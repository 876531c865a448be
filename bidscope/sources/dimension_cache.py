"""Cached report responses as JSON: their rows, and statistics by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "struct<S:array<struct<N:string>>,C:array<string>,M0:string,M1:string,M2:string,G0:string,G1:string>"
#: What of a response is read; all else in the files is ignored.
RESPONSE = (
    "results array<struct<result:struct<data:struct<descriptor:struct<Select:array<struct<Value:string,Name:string>>>,"
    f"dsr:struct<DS:array<struct<PH:array<struct<DM0:array<{_ROW}>,DM1:array<{_ROW}>,G0:array<{_ROW}>,G1:array<{_ROW}>>>>>>>>>>"
)
#: The fields by which statistics are made.
DIMENSIONS = ("entity_category", "procedure_type", "contract_type", "announcement_type", "user_type", "region", "year", "cancellation_reason")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(file, results) of all JSON files under a path; a file that isn't JSON has no results."""
    return spark.read.schema(RESPONSE).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), "results")


def response_rows(responses: DataFrame) -> DataFrame:
    """(file, part, row, fields): each row of the first result as a map of field names to values.

    Values are named by the row's own schema, or by their place where it has none; names that the descriptor knows lose what
    stands before their last dot.  Measures that stand beside the values are rows of one field each.
    """
    data = responses.filter(F.size("results") > 0).select("file", F.col("results")[0]["result"]["data"].alias("d"))
    names = F.map_from_entries(F.transform(F.coalesce(F.col("d.descriptor.Select"), F.array()), lambda s: F.struct(s["Value"], F.element_at(F.split(s["Name"], r"\."), -1))))
    parts = data.select("file", F.coalesce(names, F.create_map().cast("map<string,string>")).alias("names"), F.posexplode(F.flatten(F.transform("d.dsr.DS", lambda s: s["PH"]))).alias("ph", "p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"p.{k}").alias("rows")) for k in ("DM0", "DM1", "G0", "G1")])
    rows = parts.select("file", "names", "ph", F.explode(kinds).alias("k")).select("file", "names", F.concat("k.part", F.lit(":"), "ph").alias("part"), F.posexplode("k.rows").alias("row", "r"))
    named = lambda key: F.coalesce(F.element_at("names", key), key)
    listed = F.map_from_entries(F.transform(F.col("r.C"), lambda v, i: F.struct(F.coalesce(named(F.get(F.col("r.S"), i)["N"]), F.concat(F.lit("col_"), i.cast("string"))), v)))
    single = F.array(*[F.when(F.col(f"r.{m}").isNotNull(), F.create_map(named(F.lit(m)), F.col(f"r.{m}"))) for m in ("M0", "M1", "M2", "G0", "G1")])
    fields = F.array_compact(F.concat(F.array(F.when(F.size("r.C") > 0, listed)), single))
    return rows.select("file", "part", "row", F.explode(fields).alias("fields"))


def dimension_statistics(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, label, measure, rows, total, mean, low, high): the numbers that stand in rows with each value of a dimension."""
    pairs = F.array_compact(F.array(*[F.when(F.element_at("fields", d).isNotNull(), F.struct(F.lit(d).alias("dimension"), F.element_at("fields", d).alias("label"))) for d in dimensions]))
    each = rows.select("fields", F.explode(pairs).alias("d")).select("d.dimension", "d.label", F.explode("fields").alias("measure", "text")).filter("measure <> dimension")
    numbers = each.select("dimension", "label", "measure", F.col("text").try_cast("double").alias("v")).filter("v is not null")
    return numbers.groupBy("dimension", "label", "measure").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
