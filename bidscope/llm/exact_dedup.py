"""Exact deduplication by content-defined chunk recipes.

A text, with A-Z lower-cased, is cut where a rolling hash of its last bytes meets a mask, so equal texts are cut equally
wherever they lie.  Each distinct chunk moves once, to verify that no two different chunks share an identifier; the few
that do (none, as a rule) are told apart by SHA-256.  Documents are then compared by their ordered lists of identifiers,
8 bytes for about a thousand of text, and the texts themselves move no more.

Defined results: a null text is an empty one, whose recipe is empty; of equal texts the largest doc_id stays, ids that
are null coming before all others; if rows with that id are repeated, one of them stays; an empty table gives no rows;
other input columns are ignored (and kept by ``drop_copies``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.llm.common import ascii_lower, attach, free_name, mix64
from bidscope.workspace import materialize, release_shuffles

LEAST_CHUNK, MOST_CHUNK, MASK_BITS = 256, 8192, 10
#: One random number for each byte value, made by rule.
_GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RECIPE_SCHEMA = "doc_id long, n_bytes long, text_sha256 string, recipe binary"


def cut_points(data: np.ndarray, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of a byte array.  The rolling hash covers 16 bytes and is made for all places at once."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[data]
    for width in (1, 2, 4, 8):  # doubling: the hash of 2w bytes from those of w
        nxt = h.copy()
        nxt[width:] += h[:-width] << np.uint64(width)
        h = nxt
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << mask_bits) - 1) == 0) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks_of(text: bytes, piece: int = 1 << 22) -> Iterator[bytes]:
    """Chunks of a normalised text; a long one is cut piece by piece, each continued from the last sure cut."""
    start = 0
    while start < len(text):
        part = text[start : start + piece]
        ends = cut_points(np.frombuffer(part, np.uint8))
        if start + piece < len(text) and len(ends) > 1:
            ends = ends[:-1]
        last = 0
        for end in ends:
            yield part[last:end]
            last = end
        start += last


def _column_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _recipes(batches: Iterator[pa.RecordBatch], told_apart: frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, recipes, sizes, shas = batch.column(0), [], [], []
        for text in _column_bytes(batch.column(1)):
            text = text.lower()  # of bytes: A-Z only
            parts = []
            for chunk in chunks_of(text):
                h = xxhash.xxh3_64_intdigest(chunk)
                parts.append(h.to_bytes(8, "big") + (hashlib.sha256(chunk).digest() if h in told_apart else b""))
            recipes.append(b"".join(parts))
            sizes.append(len(text))
            shas.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], names=["doc_id", "n_bytes", "text_sha256", "recipe"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, chunks = [], []
        held = 0
        for text in _column_bytes(batch.column(0)):
            for chunk in chunks_of(text.lower()):
                ids.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                chunks.append(chunk)
                held += len(chunk)
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunks, pa.binary())], names=["id", "chunk"])
                ids, chunks, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunks, pa.binary())], names=["id", "chunk"])


def colliding_ids(docs: DataFrame) -> list[int]:
    """Chunk identifiers that stand for more than one content.  Chunks are grouped by identifier and content, first
    within each task, so each distinct chunk moves about once and a chunk that very many documents share is no hot key."""
    chunks = docs.select("text").mapInArrow(_chunk_rows, "id long, chunk binary")
    distinct = chunks.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    bad = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("id")
    return [r[0] + (1 << 63) for r in bad.collect()]  # 64-bit collisions: about one in 2^64 / chunks^2 runs has any


def recipes(docs: DataFrame, told_apart: list[int] = ()) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, recipe); identifiers in ``told_apart`` are followed by their chunk's SHA-256."""
    apart = frozenset(told_apart)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _recipes(b, apart), RECIPE_SCHEMA)


def mark_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes), one row per input row.

    Rows are counted per recipe and id before recipes are, so groups of any size combine before they shuffle; a hot
    recipe's rows meet its one group row in a join whose large side Spark splits.
    """
    release_shuffles(docs.sparkSession)
    apart = colliding_ids(docs)
    each = materialize(recipes(docs, apart).groupBy("recipe", "text_sha256", "n_bytes", "doc_id").agg(F.count(F.lit(1)).alias("rows")), "recipes")
    # Written first: a join straight onto the aggregation would take over its partitioning, which Spark can't split.
    groups = materialize(each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "recipe-groups")
    joined = each.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Of equal texts with one doc_id the row whose columns have
    the least hash stays."""
    sha, n = free_name(docs, "__sha"), free_name(docs, "__n")
    kept = mark_copies(docs).filter("kept").select("doc_id", F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(sha, F.sha2(F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8"), 256))
    one = F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.xxhash64(*docs.columns)))
    return attach(keyed, kept, ["doc_id", sha], "inner").withColumn(n, one).filter(F.col(n) == 1).select(docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH lowered AS (
  SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
marked AS (
  SELECT doc_id, t, MAX(doc_id) OVER (PARTITION BY t) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS n FROM lowered)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes FROM marked
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": OP4_SQL}
