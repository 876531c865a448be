"""Text as column expressions and set-based jobs: search ranks, extraction, complexity, chunks, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of entity types, by falling priority.
ENTITIES = {
    "IBAN": r"\b(?:MK|[A-Z]{2})\d{2}[A-Z0-9]{11,30}\b",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "TAX_ID": r"\b\d{13}\b",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b",
    "PHONE": r"\+\d[\d -]{7,14}\d",
}


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two arrays of them."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def similar_names(names: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(a, b, similarity) of distinct names that are alike.

    Names are joined on their rarest trigrams only: of a name of n trigrams, a partner shares ``least`` * n at least, so
    one of the n - ``least`` * n + 1 rarest.  What is frequent joins nothing, and no partner is lost.
    """
    n = names.select("name").distinct().withColumn("tri", trigrams(F.col("name")))
    each = n.select("name", F.explode("tri").alias("t"))
    ranked = each.join(each.groupBy("t").agg(F.count(F.lit(1)).alias("f")), "t").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("r"))  # one name's
    short = F.size("r") - F.ceil(F.size("r") * least).cast("int") + 1
    rare = ranked.select("name", F.explode(F.slice("r", 1, short)).alias("x")).select("name", "x.t")
    pairs = rare.select(F.col("name").alias("a"), "t").join(rare.select(F.col("name").alias("b"), "t"), "t").filter("a < b").select("a", "b").distinct()
    whole = lambda c: n.select(F.col("name").alias(c), F.col("tri").alias(f"{c}_tri"))
    sim = trigram_similarity(F.col("a_tri"), F.col("b_tri"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").filter(sim > least).select("a", "b", F.round(sim, 6).alias("similarity"))


def weighted_rank(fields: list[tuple[Column, float]], terms: list[str]) -> Column:
    """Sum over fields of weight x the share of terms among the field's words."""
    out = F.lit(0.0)
    for text, weight in fields:
        words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
        hits = sum((F.array_contains(words, t.lower()).cast("int") for t in terms), F.lit(0))
        out = out + hits * (weight / len(terms))
    return out


def snippet(text: Column, term: str, *, before: int = 500, length: int = 3000) -> Column:
    """The passage around the first hit of a term; the text's start if there is none."""
    at = F.locate(term.lower(), F.lower(text))
    return F.substring(text, F.greatest(F.lit(1), at - before), F.lit(length))


def extract_entities(docs: DataFrame, patterns: dict[str, str] = ENTITIES) -> DataFrame:
    """(doc_id, entity_type, entity): distinct matches of each pattern."""

    def matches(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({pattern})"), 1)
        return F.transform(hits, lambda m: F.struct(F.lit(kind).alias("entity_type"), m.alias("entity")))

    found = F.flatten(F.array(*[matches(k, p) for k, p in patterns.items()]))
    return docs.select("doc_id", F.explode(F.array_distinct(found)).alias("e")).select("doc_id", "e.entity_type", "e.entity")


def complexity(docs: DataFrame) -> DataFrame:
    """Per document: words, sentences, mean word and sentence length, share of distinct words."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    sentences = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[.!?]+"), lambda s: F.length(F.trim(s)) > 0))
    d = docs.select("doc_id", words.alias("w"), sentences.alias("sentences"))
    letters = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    n = F.size("w")
    return d.select("doc_id", n.alias("words"), "sentences", F.round(letters / F.nullif(n, F.lit(0)), 6).alias("mean_word"), F.round(n / F.nullif("sentences", F.lit(0)), 6).alias("mean_sentence"), F.round(F.size(F.array_distinct("w")) / F.nullif(n, F.lit(0)), 6).alias("variety"))


def sentence_chunks(docs: DataFrame, *, chunk_words: int = 128) -> DataFrame:
    """(doc_id, chunk, text): sentences packed in order into chunks of about ``chunk_words`` words.

    Chunks are cut where a running count of words passes a multiple of the size, so packing is a window sum.
    """
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    each = docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence")).withColumn("n", F.size(F.split(F.trim("sentence"), r"\s+")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunked = each.withColumn("chunk", F.floor(before / chunk_words).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return chunked.groupBy("doc_id", "chunk").agg(joined.alias("text"), F.sum("n").alias("words"))


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Documents of equal content: each with the first of its kind."""
    hashed = docs.select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("file_hash"))
    first = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(first, "file_hash").filter("doc_id <> first_id").select("doc_id", "first_id", "copies")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, *, query_rows: int = 1024, vector_rows: int = 8192) -> DataFrame:
    """(query_id, vec_id, label, cosine): for each row of ``queries`` (vec_id, embedding) its k nearest others among ``vectors``.

    Both sides are packed into blocks of bounded size; each pair of blocks gives k rows for each of its queries before
    anything is shuffled.  Vectors have one length; null and zero vectors have no neighbours.  Cosines are rounded to five
    places, and ties go to the smaller vec_id.
    """

    def packed(df: DataFrame, rows: int, names: list[str], prefix: str) -> DataFrame:
        whole = df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
        blocks = max(1, -(-whole.count() // rows))
        dealt = whole.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct(*names)).alias("rows"))
        return dealt.select(*[F.col(f"rows.{n}").alias(f"{prefix}{n}") for n in names if n != "embedding"], F.flatten("rows.embedding").alias(f"{prefix}embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                q_ids, q, ids, labels, v = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in range(5))
                q, v = q.reshape(len(q_ids), -1).astype(float), v.reshape(len(ids), -1).astype(float)
                norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                cosine = np.round(np.divide(q @ v.T, norms, out=np.full(norms.shape, -np.inf), where=norms > 0), 5)
                cosine[q_ids[:, None] == ids] = -np.inf
                order = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
                best = order[np.argsort(-cosine[:, order], axis=1, kind="stable")[:, :k]]
                row = np.repeat(np.arange(len(q_ids)), best.shape[1])
                found = cosine[row, best.ravel()]
                real = np.isfinite(found)
                at = best.ravel()[real]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[real]]), pa.array(ids[at]), pa.array(labels[at]), pa.array(found[real])], names=["query_id", "vec_id", "label", "cosine"])

    q = packed(queries, query_rows, ["vec_id", "embedding"], "q_")
    v = packed(vectors, vector_rows, ["vec_id", "label", "embedding"], "")
    pairs = q.join(v, how="cross").select("q_vec_id", "q_embedding", "vec_id", "label", "embedding")  # blocks, not rows
    near = pairs.mapInArrow(run, "query_id long, vec_id long, label int, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def mean_vectors(vectors: DataFrame, key: str = "label") -> DataFrame:
    """(key, place, mean) of each component, a row per component so that no vector is gathered."""
    return vectors.select(key, F.posexplode("embedding").alias("place", "x")).groupBy(key, "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def normalized(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def copied_share(docs: DataFrame, *, least: float = 0.6) -> DataFrame:
    """(doc_id, copied): the share of a document's distinct five-word shingles that another document has too.

    Shingles are counted by hash over all documents, so no two documents are compared.
    """
    clean = docs.select("doc_id", F.split(normalized(F.col("text")), " ").alias("w"))
    grams = clean.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(5)), " "))))).alias("g"))
    shared = grams.groupBy("g").agg(F.count(F.lit(1)).alias("docs"))
    per = grams.join(shared, "g").groupBy("doc_id").agg(F.round(F.count_if(F.col("docs") > 1) / F.count(F.lit(1)), 6).alias("copied"))
    return per.filter(F.col("copied") >= least)


#: Phrases that narrow a specification, with points.
RESTRICTIVE = (("only", 5), ("exclusively", 15), ("or equivalent", -10), ("original", 5), ("must be", 5), ("brand", 10))


def restrictiveness(docs: DataFrame, phrases=RESTRICTIVE) -> DataFrame:
    """Points of restrictive phrases per document, 0 to 100."""
    low = F.lower(F.coalesce("text", F.lit("")))
    points = sum((F.regexp_count(low, F.lit(rf"\b{p}\b")) * n for p, n in phrases), F.lit(0))
    return docs.select("doc_id", F.least(F.lit(100), F.greatest(F.lit(0), points)).alias("restrictiveness"))


def context_window(hits: DataFrame, *, budget: int = 2000, key: int = 100) -> DataFrame:
    """Per query the best passages (query_id, passage, similarity) within a budget of tokens (characters / 4).

    Passages that begin alike count once, the most similar of them.
    """
    start = F.substring("passage", 1, key)
    one = hits.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", start).orderBy(F.desc("similarity"), "passage"))).filter("__n = 1").drop("__n")
    tokens = F.ceil(F.length("passage") / 4)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "passage")
    used = one.withColumns({"place": F.row_number().over(order), "used": F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return used.filter(F.col("used") <= budget).select("query_id", "place", "passage", "similarity")


def interest_vectors(events: DataFrame, vectors: DataFrame, *, last: int = 100) -> DataFrame:
    """(user_id, place, value): weighted mean of the vectors of a user's last events; kinds weigh 1, 1.5, 2 and 2.5."""
    weight = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 1.5).when(F.col("event_type") == "signup", 2.0).when(F.col("event_type") == "purchase", 2.5)
    recent = events.withColumn("w", weight).filter("w is not null").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("n") <= last)
    parts = recent.join(vectors, recent["item_id"] == vectors["vec_id"]).select("user_id", "w", F.posexplode("embedding").alias("place", "x"))
    return parts.groupBy("user_id", "place").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 6).alias("value"))


def table_rows_to_items(tables: DataFrame) -> DataFrame:
    """Rows of extracted tables (doc_id, cells array<array<string>>), the first being the heading, to items.

    A heading's column is found by its words; rows without a name are left out.
    """
    head = F.transform(F.get("cells", F.lit(0)), lambda c: F.lower(c))

    def column(pattern: str) -> Column:
        return F.array_position(F.transform(head, lambda c: c.rlike(pattern)), True).cast("int")

    t = tables.select("doc_id", "cells", column("name|назив|опис").alias("name_at"), column("quantity|количина").alias("quantity_at"), column("price|цена").alias("price_at")).filter("name_at > 0")
    each = t.select("doc_id", "name_at", "quantity_at", "price_at", F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1)))).alias("row", "c"))
    at = lambda c: F.when(F.col(c) > 0, F.get("c", F.col(c) - 1))
    return each.select("doc_id", "row", F.trim(at("name_at")).alias("name"), at("quantity_at").try_cast("double").alias("quantity"), at("price_at").try_cast("double").alias("unit_price")).filter("name <> ''")
