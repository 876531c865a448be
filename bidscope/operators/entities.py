"""Joins that resolve entities: linked records across sources, companies across scripts, duplicate accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.functions.cleaning import normalized_company, transliterate
from bidscope.workspace import materialize

#: A score times this and a place are one number.
_PLACES = 1 << 40

#: What is left out of a buyer's name at its start and at its end.
BUYER_PREFIXES = "општина|јкп|јп|ад|дооел|доо"
BUYER_CITIES = "скопје|битола|прилеп|охрид|куманово|тетово|велес|штип|струмица|кавадарци"


def normalized_title(title: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(plain, r"""[.,;:!?\-–—'"()\[\]{}]""", "")


def normalized_buyer(name: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(plain, rf"^({BUYER_PREFIXES})\s+", ""), rf"\s+({BUYER_CITIES})$", "")


def link_tenders(left: DataFrame, right: DataFrame, *, least: int = 80) -> DataFrame:
    """The best right record of each left one at the same normalized buyer, scored by title, date, value and category code.

    Both have (id, procuring_entity, title, publication_date, estimated_value_mkd, cpv_code).  Equal titles score 100,
    contained ones 50, else 40 x the share of common words, cut to a whole number; 7, 30, 90 days apart 30, 15, 5; values
    within 5 % 20, within 20 % 10; equal codes 15, equal first five digits 8.  Without an equal title or a date within 90
    days a score reaches 80 only by a contained title with value and code alike.  So three narrow joins find all pairs:
    by title, by neighbouring quarters, and by code and neighbouring value steps; no two records meet for their buyer alone.
    Records that are equal but for their id are scored as one: of right ones the largest id counts, as among equal scores,
    and what a left one finds holds for all its copies.
    Equal titles meet first: 115 is the most that others reach, so a left record that found more meets no others.  A score
    and the right record's place among its buyer's ids are one number, so that the best is kept without sorting pairs.
    """
    if least < 76:
        raise ValueError("below 76 pairs count that the three joins don't find")
    columns = ("title", "publication_date", "estimated_value_mkd", "cpv_code")
    ready = lambda df: df.select("id", normalized_buyer(F.col("procuring_entity")).alias("buyer"), normalized_title(F.col("title")).alias("title"), *columns[1:])
    quarter = F.floor(F.datediff("publication_date", F.lit("1970-01-01").cast("date")) / 91)
    step = F.when(F.col("estimated_value_mkd") > 0, F.floor(F.log(F.col("estimated_value_mkd")) / 0.0513))  # a little over 5 %
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    facts = ["buyer", *columns]
    copies = ready(left).withColumn("of", F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256))
    copies = materialize(copies, "link-left")
    keyed = materialize(copies.select(F.col("of").alias("id"), *facts).distinct().withColumns({"quarter": quarter, "step": step, "words": words("title")}), "link-distinct")
    place = F.row_number().over(Window.partitionBy("buyer").orderBy("id"))
    r = materialize(ready(right).groupBy(*facts).agg(F.max("id").alias("id")).withColumns({"quarter": quarter, "step": step, "words": words("title"), "place": place}), "link-right")
    placed = r.select(F.col("buyer").alias("at"), F.col("place").cast("long").alias("place"), F.col("id").alias("right_id"))
    r = r.select("place", "buyer", *[F.col(c).alias(f"r_{c}") for c in (*columns, "quarter", "step", "words")])
    near = lambda name: F.explode(F.array(*[F.col(name) + n for n in (-1, 0, 1)]))
    by_title = lambda left: left.join(r, (left["buyer"] == r["buyer"]) & (F.col("title") == F.col("r_title")))
    by_date = lambda left: left.withColumn("at", near("quarter")).join(r, (left["buyer"] == r["buyer"]) & (F.col("at") == F.col("r_quarter"))).drop("at")
    by_value = lambda left: left.withColumn("at", near("step")).join(r, (left["buyer"] == r["buyer"]) & (F.col("at") == F.col("r_step")) & (F.col("cpv_code") == F.col("r_cpv_code"))).drop("at")
    days = F.abs(F.datediff("publication_date", "r_publication_date"))
    a, b = F.col("estimated_value_mkd"), F.col("r_estimated_value_mkd")
    ratio = F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))
    rest = (
        F.when(days <= 7, 30).when(days <= 30, 15).when(days <= 90, 5).otherwise(0) + F.when(ratio > 0.95, 20).when(ratio > 0.8, 10).otherwise(0)
        + F.when(F.col("cpv_code") == F.col("r_cpv_code"), 15).when(F.substring("cpv_code", 1, 5) == F.substring("r_cpv_code", 1, 5), 8).otherwise(0)
    )
    overlap = F.size(F.array_intersect("words", "r_words")) / F.nullif(F.greatest(F.size("words"), F.size("r_words")), F.lit(0))
    like = F.when(F.contains("title", F.col("r_title")) | F.contains("r_title", F.col("title")), 50).otherwise(F.coalesce(F.floor(F.round(overlap * 40, 9)), F.lit(0)))
    best = lambda pairs, score: pairs.select("id", keyed["buyer"].alias("buyer"), score.cast("int").alias("score"), "place").filter(F.col("score") >= least).groupBy("id", "buyer").agg(F.max(F.col("score") * _PLACES + F.col("place")).alias("best"))
    other = lambda pairs: best(pairs.filter((F.col("title") != F.col("r_title")) & (rest >= least - 50)), like + rest)
    titled = materialize(best(by_title(keyed), 100 + rest), "link-titled")
    keyed = materialize(keyed.join(titled.filter(F.col("best") >= 116 * _PLACES), "id", "left_anti"), "link-open")
    found = titled.unionByName(other(by_date(keyed))).unionByName(other(by_value(keyed))).groupBy("id", "buyer").agg(F.max("best").alias("best"))
    found = found.select(F.col("id").alias("of"), F.col("buyer").alias("at"), F.shiftright("best", 40).cast("int").alias("score"), F.col("best").bitwiseAND(F.lit(_PLACES - 1)).alias("place")).join(placed, ["at", "place"])
    return copies.select("id", "of").join(found, "of").select("id", "right_id", "score")


def match_companies(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, registered) across scripts: normalized, or transliterated then normalized; the same script wins."""
    key = normalized_company(F.col("name"))
    cyr = normalized_company(F.upper(transliterate(F.col("name"))))
    left = names.select("name").distinct().select("name", F.explode(F.array(F.struct(F.lit(1).alias("pass"), key.alias("k")), F.struct(F.lit(2).alias("pass"), cyr.alias("k")))).alias("e")).select("name", "e.pass", "e.k")
    right = registry.select(F.col("name").alias("registered")).distinct().withColumn("k", normalized_company(F.col("registered")))
    w = Window.partitionBy("name").orderBy("pass", "registered")
    return left.join(right, "k").withColumn("n", F.row_number().over(w)).filter("n = 1").select("name", "registered", "pass")


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """(id, base_class, base_size, plain_class, plain_size, near): how each e-mail account (id, email) resembles others of its domain.

    Names that are equal without an alias after ``+`` (score 95), or without digits (85), form classes named by their least
    id.  ``near`` counts the accounts that are one or two edits away (score 100 - 20 for each) and not of the same plain
    class.  Names within two edits have a string in common once up to two letters of each are left out, so they meet by
    an equal one of these; of one name at each domain only its class takes part.
    """
    local = F.split_part("email", F.lit("@"), F.lit(1))
    base = F.lower(F.split_part(local, F.lit("+"), F.lit(1)))
    a = accounts.select("id", base.alias("base"), F.regexp_replace(base, r"\d", "").alias("plain"), F.lower(F.split_part("email", F.lit("@"), F.lit(2))).alias("domain")).filter("domain <> ''")
    by = lambda key, name: a.groupBy("domain", key).agg(F.min("id").alias(f"{name}_class"), F.count(F.lit(1)).alias(f"{name}_size"))
    bases = a.select("domain", "base", "plain").distinct().join(by("base", "base"), ["domain", "base"])
    without = lambda text: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    once = F.when(F.length("base") > 0, without(F.col("base"))).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform("once", lambda t: F.when(F.length(t) > 0, without(t)).otherwise(F.array().cast("array<string>"))))
    keys = bases.withColumn("once", once).withColumn("k", F.explode(F.array_distinct(F.concat(F.array("base"), F.col("once"), twice))))
    x = keys.select("domain", "k", "base", "plain")
    y = keys.select("domain", "k", F.col("base").alias("other"), F.col("plain").alias("other_plain"), F.col("base_size").alias("n"))
    met = x.join(y, ["domain", "k"]).filter((F.col("base") != F.col("other")) & (F.col("plain") != F.col("other_plain")) & (F.levenshtein("base", "other", 2) >= 0))
    near = met.select("domain", "base", "other", "n").distinct().groupBy("domain", "base").agg(F.sum("n").alias("near"))
    j = a.join(by("base", "base"), ["domain", "base"]).join(by("plain", "plain"), ["domain", "plain"]).join(near, ["domain", "base"], "left")
    return j.select("id", "base_class", "base_size", "plain_class", "plain_size", F.coalesce("near", F.lit(0)).alias("near"))
