"""Alerts on tenders as they arrive: matches with saved preferences, each sent once, and evaluation that goes on where it stopped.

Every batch's results are written under the batch's number, and a batch that runs again writes the same files anew; what was
sent before is read from the batches before it.  Both live in the checkpoint's folder, so a stopped stream goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.operators.cases import keyword_places
from bidscope.workspace import fresh_path, materialize

#: Widest value band, as a power of two.
_BANDS = 64


def value_band(value) -> F.Column:
    """Number of the power of two below a value; 0 for less than 1."""
    return F.when(value >= 1, F.floor(F.log2(value))).otherwise(0).cast("int")


def preference_matches(tenders: DataFrame, preferences: DataFrame) -> DataFrame:
    """(user_id, tender_id, rule): keyword, cpv, entity and budget matches of tenders with preferences.

    Preferences are (user_id, keywords, excluded, cpv_codes, entities, min_budget, max_budget), a row per user.  Keywords and
    excluded words are sought in title and category, entities in the buyer's name, of codes the first four digits count; a
    tender with an excluded word matches nothing.  Keywords of up to three characters match whole words only.  Each kind of
    match is a join on equal values; budgets meet tenders by bands of value first.
    """
    text = F.concat_ws(" ", "title", "category")
    t = materialize(tenders.select("tender_id", text.alias("text"), "procuring_entity", F.substring("cpv_code", 1, 4).alias("cpv4"), F.col("estimated_value_mkd").alias("value")), "arrived")
    listed = lambda c: preferences.select("user_id", F.explode(F.array_distinct(c)).alias("keyword"))

    def sought(column: str, words: DataFrame, whole_words: bool) -> DataFrame:
        found = keyword_places(t.select(F.col(column).alias("value")), words.select("keyword"))
        if whole_words:
            bounded = F.array_contains(F.split(F.lower("value"), r"[^\p{L}\p{N}_]+"), F.lower("keyword"))
            found = found.filter((F.length("keyword") > 3) | bounded)
        return t.select("tender_id", F.col(column).alias("value")).join(found, "value").join(words, "keyword").select("user_id", "tender_id").distinct()

    keyword, excluded, entity = sought("text", listed("keywords"), True), sought("text", listed("excluded"), False), sought("procuring_entity", listed("entities"), False)
    codes = preferences.select("user_id", F.explode(F.array_distinct(F.transform("cpv_codes", lambda c: F.substring(c, 1, 4)))).alias("cpv4")).distinct()
    low, high = F.coalesce(F.nullif("min_budget", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.nullif("max_budget", F.lit(0.0)), F.lit(float(1 << 62)))
    ranges = preferences.filter("coalesce(min_budget, 0) > 0 or coalesce(max_budget, 0) > 0").select("user_id", low.alias("low"), high.alias("high"))
    bands = ranges.filter("low <= high").withColumn("band", F.explode(F.sequence(value_band(F.col("low")), F.least(value_band(F.col("high")), F.lit(_BANDS)))))
    budget = t.filter("value > 0").withColumn("band", value_band(F.col("value"))).join(bands, "band").filter("value between low and high").select("user_id", "tender_id")
    cpv = t.join(codes, "cpv4").select("user_id", "tender_id")
    rules = {"keyword": keyword, "cpv": cpv, "entity": entity, "budget": budget}
    out = None
    for rule, found in rules.items():
        found = found.select("user_id", "tender_id", F.lit(rule).alias("rule"))
        out = found if out is None else out.unionByName(found)
    return out.join(excluded, ["user_id", "tender_id"], "left_anti")


def _run_once(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def _before(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame | None:
    """What the batches before ``number`` wrote; batches are numbered from 0 without gaps."""
    if not number:
        return None
    return spark.read.schema(schema).parquet(*[f"{folder}/batch={n}" for n in range(number)])


def instant_alerts(stream: DataFrame, preferences: DataFrame, *, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """(user_id, tender_id, rule) of all tenders of a stream, each sent once, however often a tender arrives.

    A later run with the same ``checkpoint`` and ``out`` takes what has arrived since.
    """
    spark = stream.sparkSession
    checkpoint, out = checkpoint or fresh_path(spark, "instant-state"), out or fresh_path(spark, "instant-alerts")
    kinds = {f.name: f.dataType.simpleString() for f in preferences.select("user_id").schema} | {f.name: f.dataType.simpleString() for f in stream.select("tender_id").schema}
    schema = ", ".join([*(f"{n} {t}" for n, t in kinds.items()), "rule string"])

    def batch(df: DataFrame, number: int) -> None:
        found = preference_matches(df, preferences).dropDuplicates(["user_id", "tender_id", "rule"])
        sent = _before(spark, out, number, schema)
        new = found if sent is None else found.join(sent, ["user_id", "tender_id", "rule"], "left_anti")
        new.select("user_id", "tender_id", "rule").write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run_once(stream, checkpoint, batch)
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def evaluate_arrivals(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], keys: list[str], *, at: str = "analyzed_at", checkpoint: str | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, runs) of a stream of rows with a time ``at``: ``evaluate`` gives a batch's alerts, and of those equal in ``keys``
    the first batch's stay.  ``runs`` has for each batch (batch, evaluated, alerts, since, until); ``until`` is the mark that the
    next batch's ``since`` takes up, the latest time so far.
    """
    spark = stream.sparkSession
    checkpoint, out = checkpoint or fresh_path(spark, "evaluation-state"), out or fresh_path(spark, "evaluation")
    kinds: dict[str, str] = {}

    def batch(df: DataFrame, number: int) -> None:
        df = materialize(df, "evaluated")
        found = evaluate(df).dropDuplicates(keys)
        kinds.update({f.name: f.dataType.simpleString() for f in found.schema})
        schema = ", ".join(f"{n} {t}" for n, t in kinds.items())
        old = _before(spark, f"{out}/alerts", number, schema)
        new = found if old is None else found.join(old.select(*keys), keys, "left_anti")
        new.select(*found.columns).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        wrote = spark.read.schema(schema).parquet(f"{out}/alerts/batch={number}").count()
        told = df.agg(F.lit(number).alias("batch"), F.count(F.lit(1)).alias("evaluated"), F.lit(wrote).cast("long").alias("alerts"), F.max(F.col(at).cast("timestamp")).alias("latest"))
        if number:
            last = spark.read.parquet(f"{out}/runs/batch={number - 1}").select(F.col("until").alias("since"))
            told = told.crossJoin(last)  # one row each
        else:
            told = told.withColumn("since", F.lit(None).cast("timestamp"))
        told = told.select("evaluated", "alerts", "since", F.coalesce(F.greatest("latest", "since"), "latest", "since").alias("until"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{out}/runs/batch={number}")

    _run_once(stream, checkpoint, batch)
    return spark.read.parquet(f"{out}/alerts").drop("batch"), spark.read.parquet(f"{out}/runs")
