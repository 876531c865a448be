"""Mixing sources to target weights, built from SQL functions only.

Every document gets a hash-random key, the MD5 of its id and text.  Within a source the keys' leading digits are its ranges,
equally full because the keys are uniform.  Rows equal in source and key are one group: of them only the number counts, so
however many they are they take one row of a range.  Word counts are summed inside each range and over the ranges before it,
and a source is cut where that running sum meets its budget, after as many whole epochs as the budget holds.  Only in the
one group of a source in which the cut falls do equal rows take different numbers of words; they are numbered in parts.

Defined results: a null text has size 0; null sources are one source, last in order; a source whose documents are all
empty has target 0; repeated rows are documents of their own, the first of them taken; a null doc_id is an empty one; an
empty table gives no rows; other input columns are ignored.  The sources are sorted in one task, with one row for each;
more than ``most_sources`` of them raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.llm.common import WORD, attach, number_rows, partitions_for
from bidscope.workspace import materialize, release_shuffles

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) by filling to a level: targets are weight x level, stopped at most_epochs x size.

    Sources in the order of cap / weight reach their caps one after another as the level rises; the level is the one
    for the first number of capped sources at which the next is not capped.  Only one row per source is sorted in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * float(most_epochs)).alias("cap"))
    w = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*", F.coalesce(F.sum("cap").over(w), F.lit(0.0)).alias("capped"), F.coalesce(F.sum("weight").over(w), F.lit(0)).alias("capped_weight"),
        F.sum("weight").over(everything).alias("all_weight"), (F.sum("source_size").over(everything) * share).alias("total"),
    )
    level = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    # Capping a source lifts the level of the rest only while its cap lies below that level, so the right level is the highest.
    filled = filled.withColumn("level", F.max(level).over(everything))
    return filled.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: str = "", rows_each: int = 50_000, most_sources: int = 1_000_000,
    row: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken[, row]): the words that the mix takes of each document.

    ``row``, a column that tells rows apart, is carried along.
    """
    named = ["row"] if row is not None else []
    spark = docs.sparkSession
    release_shuffles(spark)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("number"), *[row.alias(n) for n in named])
    sized = materialize(sized, "mix-sizes")
    targets = source_targets(sized, weights=weights, share=share, most_epochs=most_epochs)
    targets = materialize(targets, "mix-targets")
    if targets.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    digits = next(d for d in range(1, 6) if d == 5 or 16**d >= partitions_for(sized.count(), rows_each))
    groups = materialize(sized.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("range", F.substring("key", 1, digits)), "mix-groups")
    totals = groups.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("rows")).alias("in_range"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "range", F.coalesce(F.sum("in_range").over(up_to), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = groups.withColumn("local", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    placed = attach(attach(local, offsets, ["source", "range"]), targets, ["source"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("local"))  # what is left for the group
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.least(F.col("size") * F.col("rows"), rest))
    placed = materialize(placed.select("source", "key", "source_size", "target", "epochs", "rows", "rest", F.col("size").alias("each")), "mix-places")  # so that Spark can split equal rows in the join
    joined = attach(sized, placed, ["source", "key"], "inner")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", *named]
    whole = F.col("epochs") * F.col("size")
    cut = (F.col("rows") > 1) & (F.col("rest") > 0) & (F.col("rest") < F.col("each") * F.col("rows"))
    even = joined.filter(~cut).withColumn("taken", (whole + F.floor(F.col("rest") / F.col("rows"))).cast("long")).select(columns)
    if placed.filter(cut).isEmpty():
        return even
    numbered = number_rows(joined.filter(cut), ["source", "key"], "number", "place", rows_each=rows_each)
    own = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("place") - 1) * F.col("size")))
    return even.unionByName(numbered.withColumn("taken", (whole + own).cast("long")).select(columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(text, '')) AS key, row_number() OVER () AS rn,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM per),
weighted AS (
  SELECT source, source_size, rk, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
filled AS (
  SELECT *, COALESCE(SUM(cap) OVER w, 0.0::DOUBLE) AS capped, COALESCE(SUM(weight) OVER w, 0) AS capped_weight,
         SUM(weight) OVER () AS all_weight, CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM weighted WINDOW w AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, MAX((total - capped) / (all_weight - capped_weight)) OVER () AS level FROM filled),
targets AS (SELECT source, source_size, LEAST(cap, weight * level) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size,
         COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size, s.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s),
joined AS (
  SELECT p.*, t.source_size, t.target, CAST(ROUND(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(ROUND(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + LEAST(size, GREATEST(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM joined
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": OP7_SQL}
