"""Text measures over documents: packed sentences, relevance, sections, entities settled by priority, completeness, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.text import ENTITIES, extract_entities, trigram_similarity, trigrams

#: Words of a result without data, patterns of one with data, and what its number of hits stands before.
BAD_SIGNS = (
    "Не најдов", "не најдов", "Нема податоци", "нема податоци", "Премногу кратки", "Не се дадени", "не е пронајден", "Нема резултати", "нема резултати", "Error", "грешка", "не успеа",
    "Веб пребарувањето не врати резултати",
)
GOOD_SIGNS = (
    r"\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*МКД", r"\d{4}-\d{2}-\d{2}", r"\d+/\d{4}", r"EPAZAR-[A-Z0-9]+", r"Победник:", r"Вредност:", r"Набавувач:", r"Договорена вредност", r"единечна цена", r"\d+ резултат",
)
HITS = r"(\d+)\s*(?:резултат|тендер|понуд)"


def row_count() -> Column:
    return F.count(F.lit(1))


def packed_sentences(docs: DataFrame, *, chunk_words: int = 128, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk, sentences, words): sentences packed in order, each chunk beginning with the last of the one before."""
    each = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), 0)).alias("pos", "sentence"))
    each = each.withColumn("words", F.regexp_count("sentence", F.lit(r"\S+"))).filter("words > 0")
    w = Window.partitionBy("doc_id").orderBy("pos")
    raw = F.floor(F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / chunk_words)
    placed = each.withColumn("raw", raw).withColumn("chunk", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("raw")))
    from_end = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy(F.desc("pos")))
    last = F.max("chunk").over(Window.partitionBy("doc_id"))
    shown = F.when((F.col("from_end") <= overlap) & (F.col("chunk") < F.col("last")), F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))
    dealt = placed.withColumns({"from_end": from_end, "last": last}).select("doc_id", "words", F.explode(shown).alias("chunk"))
    return dealt.groupBy("doc_id", "chunk").agg(row_count().alias("sentences"), F.sum("words").alias("words"))


def relevance(title: Column, text: Column, query: str) -> Column:
    """Twice the trigram likeness of the title and once that of the text; 1.5 or 0.8 at least where either holds the query."""
    q = trigrams(F.lit(query))
    likeness = lambda c: F.coalesce(trigram_similarity(trigrams(F.coalesce(c, F.lit(""))), q), F.lit(0.0))
    held = lambda c, n: F.when(F.contains(F.lower(c), F.lit(query.lower())), n).otherwise(0.0)
    return F.greatest(2 * likeness(title) + likeness(text), held(title, 1.5), held(text, 0.8))


def meaningful_sections(docs: DataFrame, *, least: int = 50, least_letters: float = 0.3) -> DataFrame:
    """Lines of a document that are long enough and have enough letters."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(lines, lambda s: (F.length(s) >= least) & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.length(s) >= least_letters))
    return docs.select("doc_id", kept.alias("s")).select("doc_id", F.size("s").alias("sections"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("characters"))


def settled_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, normalized, entity_type): each normalized mention once, under the type of the highest priority."""
    order = {k: n for n, k in enumerate(ENTITIES)}
    rank = F.coalesce(*[F.when(F.col("entity_type") == k, n) for k, n in order.items()])
    plain = F.upper(F.regexp_replace("entity", r"[^A-Za-z0-9@.]", ""))
    found = extract_entities(docs).select("doc_id", plain.alias("normalized"), F.struct(rank.alias("rank"), "entity_type").alias("r"))
    return found.groupBy("doc_id", "normalized").agg(F.min("r")["entity_type"].alias("entity_type"))


def completeness(tenders: DataFrame, documents: DataFrame, required: DataFrame) -> DataFrame:
    """(tender_id, present, needed, share): which of the document kinds that its procedure requires a tender has.

    ``documents`` has (tender_id, kind), ``required`` (procedure_type, kind).
    """
    need = tenders.select("tender_id", "procedure_type").join(required, "procedure_type")
    has = documents.select("tender_id", "kind").distinct().withColumn("there", F.lit(1))
    return need.join(has, ["tender_id", "kind"], "left").groupBy("tender_id").agg(F.count("there").alias("present"), row_count().alias("needed"), F.round(F.count("there") / row_count(), 6).alias("share"))


def timing_anomalies(documents: DataFrame) -> DataFrame:
    """Per tender: documents uploaded after closing, repeated contents, and days with three or more uploads.

    ``documents`` has (tender_id, text, uploaded, closing_date).
    """
    per_day = documents.groupBy("tender_id", "uploaded").agg(row_count().alias("n"), F.count_if(F.col("uploaded") > F.col("closing_date")).alias("late"))
    days = per_day.groupBy("tender_id").agg(F.sum("late").alias("late"), F.count_if(F.col("n") >= 3).alias("crowded_days"))
    hashed = documents.select("tender_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return days.join(hashed.groupBy("tender_id").agg((row_count() - F.count_distinct("h")).alias("repeated")), "tender_id")


def inferred_codes(docs: DataFrame, keywords: dict[str, dict[str, int]]) -> DataFrame:
    """(doc_id, code, score): the code whose keywords' points are most in a text; none where no keyword occurs."""
    low = F.lower(F.coalesce("text", F.lit("")))
    points = [F.struct(sum((F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in words.items()), F.lit(0)).alias("score"), F.lit(code).alias("code")) for code, words in sorted(keywords.items())]
    best = F.array_max(F.array(*points))
    return docs.select("doc_id", best.alias("m")).select("doc_id", "m.code", "m.score").filter("score > 0")


def result_quality(text: Column) -> Column:
    """How much a result text seems to tell, 0 to 1: signs of data add, signs of none take away, length and many hits add a little."""
    t = F.coalesce(text, F.lit(""))
    bad = sum((F.contains(t, F.lit(p)).cast("int") for p in BAD_SIGNS), F.lit(0))
    good = sum((F.regexp_like(t, F.lit(p)).cast("int") for p in GOOD_SIGNS), F.lit(0))
    yes = lambda test: F.when(test, 0.1).otherwise(0.0)
    hits = F.coalesce(F.regexp_extract(t, HITS, 1).try_cast("double"), F.lit(0.0))
    more = F.when(bad == 0, yes(F.length(t) > 500) + yes(F.length(t) > 1500)).otherwise(0.0) + yes(hits >= 3) + yes(hits >= 5)
    score = 0.5 - F.least(F.lit(0.4), bad * 0.15) + F.least(F.lit(0.5), good * 0.1) + more
    return F.when(t == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))
