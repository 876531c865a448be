"""Investigation cases: tenders found for known cases, chains of evidence, the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.workspace import materialize

#: Points of a keyword by where it is found, and the names of points.
POINTS = {"procuring_entity": 2, "title": 1, "winner": 3}
CONFIDENCE = ((5, "exact"), (3, "partial"))
#: Of events on one day, which comes first.
ORDER = {"published": 1, "amended": 2, "closed": 3, "flagged": 4, "awarded": 5, "linked": 6}
_GRAM = 3


def grams(text: Column, size: int = _GRAM) -> Column:
    """Distinct pieces of ``size`` characters of a text, or the whole text if it is shorter."""
    last = F.greatest(F.length(text) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))))


def keyword_places(values: DataFrame, keywords: DataFrame) -> DataFrame:
    """(value, keyword) for each distinct text of ``values`` (value) that contains a keyword of ``keywords`` (keyword), upper
    and lower case alike.

    A text that contains a keyword has all its pieces of three characters, so texts and keywords meet by the keyword's
    piece that the fewest texts have, and only then is containment asked.  Keywords under three characters are sought
    among the pieces' own parts.
    """
    texts = materialize(values.filter(F.col("value").isNotNull()).select(F.lower("value").alias("low"), "value").distinct(), "keyword-texts")
    words = keywords.select(F.lower("keyword").alias("key"), "keyword").filter("keyword <> ''").distinct()
    pieces = texts.select("value", F.explode(grams(F.col("low"))).alias("gram"))
    common = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long = words.filter(F.length("key") >= _GRAM).select("key", "keyword", F.explode(grams(F.col("key"))).alias("gram"))
    rarest = long.join(common, "gram").groupBy("key", "keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("known"), F.first(F.size(grams(F.col("key")))).alias("all"))
    rarest = materialize(rarest.filter(F.col("known") == F.col("all")).select("key", "keyword", "gram"), "keyword-pieces")  # no text has a piece that is not counted
    found = pieces.join(rarest, "gram").filter(F.contains(F.lower("value"), F.col("key"))).select("value", "keyword")
    short = words.filter(F.length("key") < _GRAM)
    parts = texts.select("value", F.explode(F.array_distinct(F.concat(grams(F.col("low"), 1), grams(F.col("low"), 2)))).alias("key"))
    return found.unionByName(parts.join(short, "key").select("value", "keyword"))


def matched_cases(cases: DataFrame, tenders: DataFrame, *, most: int = 50) -> DataFrame:
    """(case_id, tender_id, points, confidence, reasons, estimated_value_mkd): the ``most`` dearest tenders of each case.

    Cases are (case_id, institution_keywords, product_keywords, company_keywords, first_year, last_year, least_value).  A tender
    matches if it has an institution and a product keyword, where the case has such, or a company keyword, within the years
    and from the value on; each keyword found counts once.  Cases without keywords match nothing.
    """
    lists = {"procuring_entity": "institution_keywords", "title": "product_keywords", "winner": "company_keywords"}
    t = tenders.select("tender_id", "title", "procuring_entity", "winner", "estimated_value_mkd", F.year("publication_date").alias("year"))
    hits = None
    for column, listed in lists.items():
        asked = cases.select("case_id", F.explode(F.array_distinct(listed)).alias("keyword"))
        values = materialize(keyword_places(tenders.select(F.col(column).alias("value")), asked.select("keyword")), "keyword-values")
        own = t.select("tender_id", F.col(column).alias("value")).join(values, "value").join(asked, "keyword").select("case_id", "tender_id", F.lit(column).alias("place"), "keyword")
        hits = own if hits is None else hits.unionByName(own)
    n = lambda place: F.count_if(F.col("place") == place)
    reason = F.sort_array(F.collect_set(F.concat_ws(": ", "place", "keyword")))  # a case's own keywords
    found = hits.groupBy("case_id", "tender_id").agg(*[n(p).alias(f"in_{p}") for p in POINTS], reason.alias("reasons"))
    has = cases.select("case_id", F.size("institution_keywords").alias("inst"), F.size("product_keywords").alias("prod"), "first_year", "last_year", "least_value")
    needed = ((F.col("inst") > 0) | (F.col("prod") > 0)) & ((F.col("inst") <= 0) | (F.col("in_procuring_entity") > 0)) & ((F.col("prod") <= 0) | (F.col("in_title") > 0))
    rows = found.join(has, "case_id").filter(needed | (F.col("in_winner") > 0)).join(t.select("tender_id", "year", "estimated_value_mkd"), "tender_id")
    rows = rows.filter(F.col("year").between(F.col("first_year"), F.col("last_year")) & (F.col("least_value").isNull() | (F.col("estimated_value_mkd") >= F.col("least_value"))))
    points = sum((F.col(f"in_{p}") * w for p, w in POINTS.items()), F.lit(0))
    confidence = F.lit("possible")
    for least, name in reversed(CONFIDENCE):
        confidence = F.when(F.col("points") >= least, name).otherwise(confidence)
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("estimated_value_mkd").desc_nulls_last(), "tender_id"))
    ranked = rows.withColumn("points", points).withColumn("rank", rank).filter(F.col("rank") <= most)
    return ranked.select("case_id", "tender_id", "points", confidence.alias("confidence"), F.array_join("reasons", "; ").alias("reasons"), "estimated_value_mkd")


def linked_entities(attached: DataFrame, edges: DataFrame, *, hops: int = 2) -> DataFrame:
    """(case_id, entity, hop, via, since): entities within ``hops`` of those attached (case_id, entity) over edges (src, dst, since),
    each by the shortest way, of equals by the earliest and then least neighbour."""
    both = edges.select("src", "dst", "since").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "since"))
    both = materialize(both.groupBy("src", "dst").agg(F.min("since").alias("since")), "entity-edges")
    seen = materialize(attached.select("case_id", "entity").distinct().select("case_id", "entity", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("date").alias("since")), "linked")
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(both, front["entity"] == both["src"]).select("case_id", F.col("dst").alias("entity"), F.struct(both["since"], F.col("src").alias("via")).alias("way"))
        step = step.groupBy("case_id", "entity").agg(F.min("way").alias("way")).join(seen.select("case_id", "entity"), ["case_id", "entity"], "left_anti")
        front = materialize(step.select("case_id", "entity", F.lit(hop).alias("hop"), "way.via", "way.since"), "linked")
        seen = seen.unionByName(front)
    return seen


def evidence_chain(case_tenders: DataFrame, tenders: DataFrame, flags: DataFrame, amendments: DataFrame, edges: DataFrame, *, hops: int = 2) -> DataFrame:
    """(case_id, place, at, kind, subject, detail, days_since, flags_so_far, worst_so_far): what happened in each case, in order.

    Events are the publication, amendments, closing, award and flags of the case's tenders (case_id, tender_id), and the links
    of their winners to other companies, ``hops`` at most, on the day that a link was first seen.  A flag counts from the
    closing of its tender on.  Events without a date are left out; a case's events are one ordered window.
    """
    own = materialize(case_tenders.select("case_id", "tender_id").distinct().join(tenders.select("tender_id", "publication_date", "closing_date", "contract_signing_date", "winner", "estimated_value_mkd"), "tender_id"), "case-tenders")
    event = lambda df, kind, at, subject, detail, score=None: df.select("case_id", F.lit(kind).alias("kind"), at.cast("date").alias("at"), subject.alias("subject"), detail.cast("string").alias("detail"), (F.lit(None) if score is None else score).cast("int").alias("score"))
    c = F.col
    published = event(own, "published", c("publication_date"), c("tender_id"), F.lit(""))
    closed = event(own, "closed", c("closing_date"), c("tender_id"), F.lit(""))
    awarded = event(own.filter("winner is not null"), "awarded", c("contract_signing_date"), c("tender_id"), c("winner"))
    amended = event(own.select("case_id", "tender_id").join(amendments.select("tender_id", "amendment_date", "field_changed"), "tender_id"), "amended", c("amendment_date"), c("tender_id"), c("field_changed"))
    flagged = event(own.select("case_id", "tender_id", "closing_date").join(flags.select("tender_id", "flag_type", "score"), "tender_id"), "flagged", c("closing_date"), c("tender_id"), c("flag_type"), c("score"))
    links = linked_entities(own.filter("winner is not null").select("case_id", c("winner").alias("entity")), edges, hops=hops).filter("hop > 0")
    linked = event(links, "linked", c("since"), c("entity"), F.concat(c("hop").cast("string"), F.lit(" via "), c("via")))
    events = published
    for part in (closed, awarded, amended, flagged, linked):
        events = events.unionByName(part)
    rank = F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("case_id").orderBy("at", F.element_at(rank, c("kind")), "subject", "detail")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return events.filter(c("at").isNotNull()).select(
        "case_id", F.row_number().over(w).alias("place"), "at", "kind", "subject", "detail", F.datediff("at", F.lag("at").over(w)).alias("days_since"),
        F.count_if(c("kind") == "flagged").over(so_far).alias("flags_so_far"), F.max("score").over(so_far).alias("worst_so_far"),
    )


def case_dashboard(cases: DataFrame, case_tenders: DataFrame, evidence: DataFrame) -> DataFrame:
    """(facet, value, cases, tenders, evidence) over cases (case_id, status, priority, assigned_to): all, by status, by priority,
    and the open ones by analyst."""
    n = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    rows = cases.join(n(case_tenders.select("case_id", "tender_id").distinct(), "tenders"), "case_id", "left").join(n(evidence, "evidence"), "case_id", "left").fillna(0, ["tenders", "evidence"])
    is_open = ~F.col("status").isin("closed", "archived")
    facets = F.array(
        F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")), F.struct(F.lit("priority").alias("facet"), F.col("priority").alias("value")),
        F.struct(F.when(is_open, "open").alias("facet"), F.lit("open").alias("value")), F.struct(F.when(is_open & F.col("assigned_to").isNotNull(), "analyst").alias("facet"), F.col("assigned_to").alias("value")),
    )
    each = rows.select("tenders", "evidence", F.explode(facets).alias("f")).filter("f.facet is not null")
    return each.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("cases"), F.sum("tenders").alias("tenders"), F.sum("evidence").alias("evidence"))


def cluster_statistics(members: DataFrame, tenders: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per cluster (cluster, member): members, tenders in which two of them bid, their wins there, value won, and a level by size."""
    m = members.select("cluster", F.col("member").alias("company_name")).distinct()
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    met = bidders.join(m, "company_name").groupBy("cluster", "tender_id").agg(F.count_distinct("company_name").alias("n"), F.max("is_winner").alias("won")).filter("n >= 2")
    per = met.join(tenders.select("tender_id", "actual_value_mkd"), "tender_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("tenders"), F.count_if("won").alias("wins"), F.coalesce(F.sum(F.when(F.col("won"), F.col("actual_value_mkd"))), F.lit(0.0)).alias("value"))
    level = F.when(F.col("members") >= 5, "high").when(F.col("members") >= 3, "medium").otherwise("low")
    return size.join(per, "cluster", "left").fillna(0, ["tenders", "wins"]).fillna(0.0, ["value"]).withColumn("level", level)
