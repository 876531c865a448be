"""Anomalies of a tender's files and contents, what its documents add to its risk, and an institution's document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least meaningful bytes, sizes that are suspiciously round, their tolerance, and points by severity.
LEAST_BYTES, ROUND_TOLERANCE = 1024, 100
ROUND_SIZES = (1024 * 1024, 2 * 1024 * 1024, 5 * 1024 * 1024, 10 * 1024 * 1024)
SEVERITY_POINTS = {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0}
TIMING_WEIGHTS = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2}


def _found(df: DataFrame, kind: str, severity: Column | str, doc: Column, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("tender_id", F.lit(kind).alias("kind"), severity.alias("severity"), doc.cast("long").alias("doc_id"), detail.cast("string").alias("detail"))


def file_anomalies(documents: DataFrame) -> DataFrame:
    """(tender_id, kind, severity, doc_id, detail) over (tender_id, doc_id, file_name, file_size_bytes, extraction_status).

    Empty and tiny files; sizes that two files of different names share; sizes near whole megabytes; tenders of three documents
    at least of which half failed.  What concerns a tender and no one document has no doc_id.
    """
    size, none = F.col("file_size_bytes"), F.lit(None)
    tiny = _found(documents.filter(size.between(0, LEAST_BYTES - 1)), "empty_file", F.when(size == 0, "high").otherwise("medium"), F.col("doc_id"), size)
    same = documents.filter(size > LEAST_BYTES).groupBy("tender_id", "file_size_bytes").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_name").alias("names")).filter("names >= 2")
    near = F.coalesce(*[F.when(F.abs(size - r) < ROUND_TOLERANCE, r) for r in ROUND_SIZES])
    failed = documents.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("extraction_status") == "failed").alias("bad")).filter("n >= 3 and bad >= n * 0.5 and bad > 0")
    parts = [
        tiny, _found(same, "size_anomaly", "medium", none, F.concat_ws(" x ", "n", "file_size_bytes")), _found(documents.filter(near.isNotNull()), "size_anomaly", "low", F.col("doc_id"), near),
        _found(failed, "size_anomaly", "medium", none, F.concat_ws(" of ", "bad", "n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def content_anomalies(documents: DataFrame) -> DataFrame:
    """The same columns over (tender_id, doc_id, text, file_size_bytes, page_count, extraction_status): large files with little
    text, and many pages with little on each, of those that were read."""
    read = documents.filter(F.col("extraction_status") == "success").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    thin = read.filter((F.col("file_size_bytes") > 10240) & (F.col("n") < 100))
    blank = read.filter((F.col("page_count") > 5) & (F.col("n") > 0) & (F.col("n") / F.col("page_count") < 50))
    return _found(thin, "empty_file", "medium", F.col("doc_id"), F.col("n")).unionByName(_found(blank, "empty_file", "low", F.col("doc_id"), F.concat_ws(" on ", "n", "page_count")))


def _by_severity(points: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in points.items():
        out = F.when(F.col("severity") == name, value).otherwise(out)
    return out


def risk_contribution(tenders: DataFrame, completeness: DataFrame, timing: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(tender_id, completeness_score, timing_score, anomalies, contribution): 30 points for missing documents, 30 for timing, 40 for
    what is odd about files and contents, by severity.

    ``completeness`` is (tender_id, completeness_score 0 to 1), ``timing`` and ``anomalies`` are (tender_id, severity).
    """
    t = timing.groupBy("tender_id").agg(F.least(F.lit(1.0), F.sum(_by_severity(TIMING_WEIGHTS, 0.1)) / 3).alias("timing_score"))
    a = anomalies.groupBy("tender_id").agg(F.count(F.lit(1)).alias("anomalies"), F.least(F.lit(40.0), F.sum(_by_severity(SEVERITY_POINTS, 2.0))).alias("file_risk"))
    j = tenders.select("tender_id").join(completeness, "tender_id", "left").join(t, "tender_id", "left").join(a, "tender_id", "left")
    j = j.fillna(1.0, ["completeness_score"]).fillna(0.0, ["timing_score", "file_risk"]).fillna(0, ["anomalies"])
    whole = (1 - F.col("completeness_score")) * 30 + F.col("timing_score") * 30 + F.col("file_risk")
    return j.select("tender_id", F.round("completeness_score", 3).alias("completeness_score"), F.round("timing_score", 3).alias("timing_score"), "anomalies", F.round(F.least(F.lit(100.0), whole), 2).alias("contribution"))


def institution_document_statistics(tenders: DataFrame, documents: DataFrame) -> DataFrame:
    """Per buyer: tenders, documents, documents per tender, how many were read, failed or wait, tiny files, mean size, tenders without any."""
    status = lambda s: F.count_if(F.col("extraction_status") == s)
    d = documents.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), status("success").alias("ok"), status("failed").alias("bad"), status("pending").alias("wait"), F.count_if(F.col("file_size_bytes") < LEAST_BYTES).alias("tiny"), F.sum("file_size_bytes").alias("bytes"), F.count("file_size_bytes").alias("sized"))
    per = tenders.select("tender_id", "procuring_entity").join(d, "tender_id", "left").fillna(0, ["n", "ok", "bad", "wait", "tiny", "sized"]).groupBy("procuring_entity").agg(
        F.count(F.lit(1)).alias("total_tenders"), F.sum("n").alias("total_documents"), F.sum("ok").alias("success_count"), F.sum("bad").alias("failed_count"), F.sum("wait").alias("pending_count"), F.sum("tiny").alias("tiny_files_count"),
        F.round(F.try_divide(F.sum("bytes"), F.sum("sized")), 0).alias("avg_file_size_bytes"), F.count_if(F.col("n") == 0).alias("tenders_without_docs"),
    )
    share = lambda a, b, f=100.0: F.coalesce(F.round(F.try_divide(F.col(a) * f, F.col(b)), 2), F.lit(0.0))
    return per.withColumns({"avg_docs_per_tender": share("total_documents", "total_tenders", 1.0), "extraction_success_rate": share("success_count", "total_documents"), "missing_doc_rate": share("tenders_without_docs", "total_tenders")}).fillna(0.0, ["avg_file_size_bytes"])
