"""URL filters: rules on hosts and paths, and for the rest a verdict from the link graph of hosts; SQL functions only.

Trust starts at hosts whose pages the rules allow and follows links; distrust starts at hosts whose pages they block and
follows links backwards.  Both are personalised PageRank over host edges: a seed's teleport weight is the share of its
pages that such rules decide.  A host is blocked where its distrust reaches ``least_distrust`` and ``ratio`` times its
trust; hosts that neither reaches are allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; an empty
path fits no rule, since rule paths begin with ``/``; of two rules of one length that fit, the one later in code-point order
wins; a null html has no links; links within a host carry no evidence and
are left out; repeated rows each get their verdict; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import ascii_lower
from bidscope.workspace import discard, materialize, release_shuffles

#: (verdict, host, path); fits the host and its subdomains where the path begins so.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: The walk may take so many rounds; it raises where scores still move by more than the tolerance then.
ROUNDS = 500
TOLERANCE = 1e-6
RATIO = 2.0
LEAST_DISTRUST = 0.02
#: A scheme and authority inside a link attribute.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does.  For up to a few hundred rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, under in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # longer ones are asked first
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(under)
        name, verdict = F.when(fits, at + under).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): a host's links to other hosts, weighted by their share of all that it links to elsewhere."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), ascii_lower))).alias("dst"))
    counted = materialize(links.filter("dst <> host and host <> ''").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n")), "host-links")
    out = materialize(counted.groupBy("src").agg(F.sum("n").alias("all")), "host-sums")  # a table of its own, so that Spark can split a hub
    return counted.join(out, "src").select("src", "dst", "n", (F.col("n") / F.col("all")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, score) from ``seeds`` (host, seed) over ``edges`` (src, dst, weight).

    score = (1 - damping) x seed + damping x what flows in.  Each round at least shrinks what is still to move by
    ``damping``; the walk ends when no score is further than ``tolerance`` from its final value, and raises if ``rounds``
    don't reach that.  Each round's scores are written to the shared folder and the older ones deleted, so edges are joined
    with a table of its own and Spark can split the edges of a hub.
    """
    score = materialize(seeds.select("host", (F.col("seed") * (1 - damping)).alias("score")), "rank")
    nodes = seeds.select("host", "seed").unionByName(edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("seed"))).groupBy("host").agg(F.sum("seed").alias("seed"))
    nodes = materialize(nodes, "rank-nodes")
    for _ in range(rounds):
        flow = edges.join(score, edges["src"] == score["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("weight") * F.col("score")).alias("flow"))
        new = nodes.join(flow, "host", "left").select("host", (F.col("seed") * (1 - damping) + damping * F.coalesce("flow", F.lit(0.0))).alias("score"))
        before, score = score, materialize(new, "rank")
        moved = score.join(before.withColumnRenamed("score", "was"), "host", "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        discard(before)
        if moved * damping <= tolerance * (1 - damping):  # what is still to come is at most this geometric series
            return score
    raise RuntimeError(f"scores still move by {moved} after {rounds} rounds")


def judge_urls(pages: DataFrame, *, rules=RULES, ratio: float = RATIO, least_distrust: float = LEAST_DISTRUST, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)."""
    release_shuffles(pages.sparkSession)
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", name).withColumn("by_rule", verdict)
    edges = materialize(host_edges(judged), "host-edges")
    shares = materialize(
        judged.groupBy("host").agg(F.avg((F.coalesce("by_rule", F.lit("")) == "allow").cast("double")).alias("allowed"), F.avg((F.coalesce("by_rule", F.lit("")) == "block").cast("double")).alias("blocked")), "host-seeds"
    )
    if edges.isEmpty():  # no link joins two hosts: a host's own seeds decide
        trust, distrust = (shares.select("host", (F.col(c) * (1 - damping)).alias("score")) for c in ("allowed", "blocked"))
    else:
        trust = propagate(shares.select("host", F.col("allowed").alias("seed")), edges, damping=damping, rounds=rounds)
        into = materialize(edges.groupBy("dst").agg(F.sum("n").alias("all")), "host-sums")
        backwards = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
        distrust = propagate(shares.select("host", F.col("blocked").alias("seed")), backwards, damping=damping, rounds=rounds)
    hosts = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    bad = (F.col("distrust") >= least_distrust) & (F.col("distrust") >= ratio * F.col("trust"))
    hosts = hosts.fillna(0.0, ["trust", "distrust"]).withColumn("by_host", F.when(bad & (F.col("host") != ""), "block").otherwise("allow"))
    hosts = materialize(hosts, "host-verdicts")  # a join onto a table of its own lets Spark split a host of very many pages
    return judged.drop("html").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES: dict[str, str] = {}
