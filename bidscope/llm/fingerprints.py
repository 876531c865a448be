"""Document fingerprints: bottom-k sketches of word-shingle hashes, built from SQL functions only.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of a text's five-word shingles.  Sketches of parts
merge into the sketch of the whole, and two of them estimate resemblance, containment and the number of shingles.

Defined results: a null text is an empty one; a text of fewer than five words (but one at least) has one shingle, all
its words; a text without words has an empty sketch and an empty fingerprint string.  Two empty sketches are alike (1),
an empty one and another are not (0).  Documents with the same doc_id follow one another by text; a null doc_id comes
last in descending order, likewise by text.  An empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.llm.common import range_index, text_or_empty, words_of

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
HASH_BITS = 48
PREFIX_CHARS = 256


def with_sketch(df: DataFrame, text: str, out: str, *, shingle_words: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """Add the sketch of column ``text`` as an array of longs named ``out``.

    Words are hashed once; a shingle's hash is that of its words' hashes.  Each step is a projection of its own, so that
    no array is computed again inside a later lambda.
    """
    rest = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*rest, F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)).alias("__w"))
    follow = lambda i: [F.get(F.col("__w"), i + j) for j in range(1, shingle_words)]
    rolled = F.transform("__w", lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *follow(i)), 64 - HASH_BITS))
    step = step.select(*rest, F.slice(rolled, 1, F.greatest(F.size("__w") - (shingle_words - 1), F.least(F.size("__w"), F.lit(1)))).alias("__s"))
    return step.select(*rest, F.slice(F.sort_array(F.array_distinct("__s")), 1, k).alias(out))


def fingerprint_text(sketch: Column) -> Column:
    """A sketch as text: its hashes as 12 hex digits each, smallest first."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both sketches have."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    n = F.size(sketch)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / (F.element_at(sketch, -1) + 1))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merge_by(df: DataFrame, keys: list[str], sketch: str, k: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of groups from sketches of their parts.

    The k smallest distinct hashes per group come from a rank limit that Spark applies before its shuffle too, so a
    group of any size sends at most k rows from each task.
    """
    each = df.select(*keys, F.explode(sketch).alias("__h")).dropDuplicates([*keys, "__h"])
    best = each.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).filter(F.col("__n") <= k)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def with_next(df: DataFrame, carry: list[str], *, rows_each: int = 1024, most_ranges: int = 8192) -> DataFrame:
    """Add ``next_<c>`` for each column to carry: its value in the next row by descending doc_id, the first's for the last.

    Rows are dealt into ranges of doc_id of about equal size.  An id that more rows share than two ranges hold (or null)
    is dealt further by the first column to carry, a string, at splitters from a sample of it.  The rows that may lead a
    range are also sent to the range before it, so every next row is found inside a range; only rows equal in id and that
    string always share one.  At most a few rows for each range come to the driver.
    """
    tie, prefix = carry[0], F.substring(carry[0], 1, PREFIX_CHARS)
    n, low = df.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    ranges = max(1, min(most_ranges, n // rows_each))
    each = max(rows_each, n // ranges)
    cuts: set[int] = set()
    if ranges > 1 and low:
        cuts |= set(df.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 16 * ranges)).first()[0])
    crowded = {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * each).collect()} if ranges > 1 else {}
    cuts |= {c for i in crowded if i is not None for c in (i, i - 1) if c >= -(1 << 63)}  # such an id has a range of its own
    rows = []
    if crowded:
        hot = F.col("doc_id").isin([i for i in crowded if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in crowded))
        chance = F.shiftrightunsigned(F.xxhash64(tie, F.lit("next")), 11) / F.lit(float(1 << 53)) < 8.0 * ranges / sum(crowded.values())
        drawn: dict[int | None, list[str]] = {i: [] for i in crowded}
        for r in df.filter(hot & chance).select("doc_id", prefix.alias("p")).collect():  # about 8 for each range
            drawn[r["doc_id"]].append(r["p"])
        for i, found in drawn.items():
            found.sort(key=lambda p: p.encode())
            parts = -(-crowded[i] // each)
            rows.append((i, sorted({found[k * len(found) // parts] for k in range(1, parts)} if found else set(), key=lambda p: p.encode())))
    splits = df.sparkSession.createDataFrame(rows, "__id long, __splits array<string>")
    ranged = df.join(F.broadcast(splits), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    own_range = F.when(F.col("doc_id").isNull(), -1).otherwise(range_index(F.col("doc_id"), sorted(cuts))).cast("long")
    within = F.when(F.col("__splits").isNull(), 0).otherwise(F.size(F.filter("__splits", lambda s: s < F.col(tie))))
    most = 1 << 32
    placed = ranged.withColumn("__b", own_range * most + (most - 1 - within))  # a larger number comes earlier
    first = F.when(F.col("__splits").isNotNull(), prefix)
    tops = placed.groupBy("__b").agg(F.max("doc_id").alias("top"), F.min(first).alias("first")).collect()
    present = sorted((r["__b"] for r in tops), reverse=True)
    if not present:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    before = {b: present[i - 1] for i, b in enumerate(present)}  # the range that ends where this one begins; the last, for the first
    edges = df.sparkSession.createDataFrame([(r["__b"], r["top"], r["first"], before[r["__b"]]) for r in tops], "__b long, __top long, __first string, __before long")
    edged = placed.join(F.broadcast(edges), "__b")
    lead = F.col("doc_id").eqNullSafe(F.col("__top")) & (F.col("__first").isNull() | (prefix == F.col("__first")))
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo"))
    copies = F.when(lead, F.array(own, F.struct(F.col("__before").alias("b"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    dealt = edged.withColumn("__c", F.explode(copies)).select(*df.columns, F.col("__c.b").alias("__to"), F.col("__c.halo").alias("__halo"))
    w = Window.partitionBy("__to").orderBy(F.col("__halo").asc(), F.col("doc_id").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in carry])
    ahead = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return ahead.filter(~F.col("__halo")).drop("__to", "__halo")


def fingerprint_documents(docs: DataFrame, *, k: int = SKETCH_SIZE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likeness to the edited text and to the next document."""
    base = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    sketched = with_sketch(base, "text", "sketch", k=k)
    ahead = with_next(sketched, ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_sketch(ahead.withColumn("edited", edited), "edited", "edited_sketch", k=k)
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("sketch")).alias("fingerprint"), fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLES: dict[str, str] = {}
