"""From raw documents to packed sequences in five stages, each written as Parquet and read again as the next one's input.

* language: documents in no learned language go: those without letters, and those whose letters follow the learned
  languages together less than they follow chance (``LEAST_EVIDENCE``); texts that mix learned languages stay;
* exact: of equal texts (A-Z lower-cased) the largest doc_id stays;
* near: of each SimHash component the smallest doc_id stays;
* mix: sources are cut, or repeated, to their target numbers of words; a document that is repeated is so many rows;
* pack: token windows.

All stages but the last return the columns of their input.  Rows that share a doc_id, or have none, are told apart by
their texts: each stage keeps, drops or repeats them one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import free_name, number_rows, row_hash
from bidscope.llm.exact_dedup import drop_copies
from bidscope.llm.language import drop_undetermined
from bidscope.llm.mixing import mix_sources
from bidscope.llm.packing import pack_documents
from bidscope.llm.simhash import drop_near_copies
from bidscope.workspace import discard, discard_since, materialize, written

#: Least mean log likelihood ratio for each letter of the best labelling against letters at random: e times as likely.
LEAST_EVIDENCE = 1.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_undetermined(docs, least_evidence=LEAST_EVIDENCE).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs).select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's row as often as the mix takes it, to the nearest whole number of times."""
    row = row_hash("doc_id", "source", "text")
    mark, number, n, all_, rows_, copy = (free_name(docs, c) for c in ("__row", "__number", "__n", "__all", "__rows", "__copy"))
    mixed = mix_sources(docs, row=row)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    # Rows equal in all three are one to the mix; what it takes of them together is dealt out evenly again.
    taken = mixed.groupBy(F.col("row").alias(mark)).agg(F.sum(times).alias(all_), F.count(F.lit(1)).alias(rows_)).filter(F.col(all_) > 0)
    taken = materialize(taken, "mix-rows")
    rows = docs.withColumns({mark: row, number: F.monotonically_increasing_id()}).join(taken, mark)
    left = F.col(all_) % F.col(rows_)
    if taken.filter(left > 0).isEmpty():
        rows = rows.withColumn(n, F.lit(1))
    else:  # some of the equal rows are taken once more; very many of them are numbered in parts
        rows = number_rows(rows, [mark], number, n)
    each = F.floor(F.col(all_) / F.col(rows_)) + (F.col(n) <= left).cast("long")
    return rows.withColumn(copy, F.explode(F.when(each > 0, F.sequence(F.lit(1), each.cast("int"))))).select(docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Language scores, fingerprint components and token ids have no SQL twin; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself goes when its result is written, its result when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written()
        done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(spark, before, done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
