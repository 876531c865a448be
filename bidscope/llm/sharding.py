"""Sharding by sampled splitters: near equal bytes per shard, equal texts together.

The range key is a hash of the text, so equal texts are neighbours.  A sample of keys, drawn in proportion to size, gives
quantile splitters; the ranges between them are summed exactly, and those fuller than the rest are subdivided by a second
hash of the key, so equal texts stay together there too.  A text whose copies alone are many is dealt out row by row into
pieces of its own, whatever the ids of the rows: it keeps to one shard as long as the copies together are no larger than a
shard's fair bytes, and is split only beyond that.  Rows are numbered when the keys are written, so the same files, read
with the same settings, give the same shards.  Pieces are laid out over the shards, largest first, each to the shard with the fewest bytes.

At most ``ranges`` splitters, ``ranges`` texts of very many copies and a few times as many pieces ever reach the driver.

Defined results: a null text has no bytes, so size 8 and CRC 0, and is equal to an empty one; repeated rows are records of
their own, their slots in no stated order among themselves; an empty table gives no rows; other input columns are ignored.
Shards can't be even where one text alone, or the copies of one, come near a shard's fair bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscope.llm.common import range_index
from bidscope.workspace import materialize, release_shuffles

SHARDS = 24
RECORD_BYTES = 8
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 8
#: A range of more than this many times the fair bytes or rows of a range is subdivided.
CROWDED = 2


def _fraction(column: Column) -> Column:
    """A hash of the column as a number from 0 to 1."""
    return (F.shiftrightunsigned(F.xxhash64(column, F.lit("sharding")), 11)) / F.lit(float(1 << 53))


def splitters(keyed: DataFrame, total: int, ranges: int, samples_per_range: int = SAMPLES_PER_RANGE) -> list[int]:
    """Quantiles of a size-weighted sample of keys: a row is drawn with chance size x samples / total, settled by its number."""
    chance = F.col("size") * float(ranges * samples_per_range) / float(max(1, total))
    drawn = keyed.filter(_fraction(F.struct("row", "key")) < chance).select("key")
    keys = sorted(r[0] for r in drawn.collect())  # about ranges x samples_per_range of them
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def lay_out(units: list[tuple[int, list[tuple]]], shards: int) -> dict[tuple, tuple[int, int]]:
    """piece -> (shard, first slot) for units (bytes, [(piece, rows), ...]): largest first, each to the shard with the fewest bytes."""
    load = [(0, 0, s) for s in range(shards)]
    heapq.heapify(load)
    placed = {}
    for n_bytes, pieces in sorted(units, key=lambda u: (-u[0], u[1])):
        full, slots, shard = heapq.heappop(load)
        for piece, rows in sorted(pieces):
            placed[piece] = (shard, slots)
            slots += rows
        heapq.heappush(load, (full + n_bytes, slots, shard))
    return placed


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), with the text's range and piece."""
    spark = docs.sparkSession
    release_shuffles(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = materialize(docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "shard-keys")
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    ranges = max(1, min(shards * ranges_per_shard, rows))
    fair_bytes, fair_rows, shard_bytes = (total or 0) / ranges, rows / ranges, (total or 0) / shards
    ranged = keyed.withColumn("range", range_index(F.col("key"), splitters(keyed, total or 0, ranges)))
    full = lambda n_bytes, n: (n_bytes > CROWDED * fair_bytes) | (n > CROWDED * fair_rows)
    parts_of = lambda n_bytes, n: F.least(F.ceil(F.greatest(n_bytes / F.lit(fair_bytes or 1.0), n / F.lit(fair_rows or 1.0))), n)
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    # Texts of very many copies: at most as many as there are ranges.  Their rows are dealt out one by one.
    copies = ranged.groupBy("key").agg(*sums).filter("rows > 1").filter(full(F.col("bytes"), F.col("rows"))).withColumn("copy_parts", parts_of(F.col("bytes"), F.col("rows")))
    hot = {r["key"]: (r["bytes"], r["copy_parts"]) for r in copies.collect()}
    hot_table = spark.createDataFrame([(k, int(n)) for k, (_, n) in hot.items()], "key long, copy_parts int")
    marked = ranged.join(F.broadcast(hot_table), "key", "left")
    # What is left of a range without them is cut by the key where it is crowded still.
    crowded = marked.filter("copy_parts is null").groupBy("range").agg(*sums).filter(full(F.col("bytes"), F.col("rows"))).select("range", parts_of(F.col("bytes"), F.col("rows")).alias("parts"))
    range_table = spark.createDataFrame([(r["range"], int(r["parts"])) for r in crowded.collect()], "range int, parts int")
    cut = marked.join(F.broadcast(range_table), "range", "left")
    dealt = F.floor(_fraction(F.col("row")) * F.col("copy_parts"))
    by_key = F.floor(_fraction(F.col("key")) * F.coalesce("parts", F.lit(1)))
    group = F.when(F.col("copy_parts").isNotNull(), F.col("key"))  # null for the rest
    pieced = cut.select("doc_id", "size", "text_crc32", "key", "range", group.alias("copies"), F.coalesce(dealt, by_key).cast("int").alias("piece"))
    found = pieced.groupBy("range", "copies", "piece").agg(*sums).collect()
    units: dict[tuple, tuple[int, list]] = {}
    for r in found:
        together = r["copies"] is not None and hot[r["copies"]][0] <= shard_bytes
        piece = (r["range"], r["copies"] is not None, r["copies"] or 0, r["piece"])
        n_bytes, pieces = units.get(piece[:3] if together else piece, (0, []))
        units[piece[:3] if together else piece] = (n_bytes + r["bytes"], [*pieces, (piece, r["rows"])])
    placed = lay_out(list(units.values()), shards)
    columns = (("range", T.IntegerType()), ("has", T.BooleanType()), ("of", T.LongType()), ("piece", T.IntegerType()), ("shard", T.IntegerType()), ("first", T.LongType()))
    where = spark.createDataFrame([(*piece, *at) for piece, at in placed.items()], T.StructType([T.StructField(n, t, False) for n, t in columns]))
    inside = Window.partitionBy("range", "has", "of", "piece").orderBy("doc_id", "key", "text_crc32", "size")
    named = pieced.withColumns({"has": F.col("copies").isNotNull(), "of": F.coalesce("copies", F.lit(0).cast("long"))})
    return (
        named.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(where), ["range", "has", "of", "piece"])  # a few times ``ranges`` rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "range", "piece")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
