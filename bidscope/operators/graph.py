"""Graphs of companies and buyers: edge tables, and algorithms as joins over them.

Graphs are DataFrames (src, dst, weight); rounds of an algorithm are joins and aggregations whose results are written to
the shared folder every few rounds, so that a lost executor costs no more than those.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscope.operators.detectors import won
from bidscope.operators.path_counts import dependencies
from bidscope.workspace import discard, materialize


def row_count() -> Column:
    return F.count(F.lit(1))


def co_bidding_edges(tenders: DataFrame, bidders: DataFrame, *, least_together: int = 2) -> DataFrame:
    """(src, dst, weight, value, first_seen, last_seen) for companies that bid on the same tenders, src < dst."""
    t = tenders.select("tender_id", "publication_date", "estimated_value_mkd")
    one = bidders.select("tender_id", "company_name").distinct()
    a, b = one.select("tender_id", F.col("company_name").alias("src")), one.select("tender_id", F.col("company_name").alias("dst"))
    pairs = a.join(b, "tender_id").filter("src < dst").join(t, "tender_id")
    return pairs.groupBy("src", "dst").agg(row_count().alias("weight"), F.sum("estimated_value_mkd").alias("value"), F.min("publication_date").alias("first_seen"), F.max("publication_date").alias("last_seen")).filter(F.col("weight") >= least_together)


def award_edges(tenders: DataFrame) -> DataFrame:
    """(src buyer, dst winner, weight, value)."""
    return won(tenders).groupBy(F.col("procuring_entity").alias("src"), F.col("winner").alias("dst")).agg(row_count().alias("weight"), F.sum("actual_value_mkd").alias("value"))


def partnership_edges(tenders: DataFrame, *, least_awards: int = 3) -> DataFrame:
    """Award edges of some number, with the winner's share of the buyer's awards."""
    edges = award_edges(tenders)
    total = edges.groupBy("src").agg(F.sum("weight").alias("awards"))
    return edges.filter(F.col("weight") >= least_awards).join(total, "src").select("src", "dst", "weight", "value", F.round(F.col("weight") * 100.0 / F.col("awards"), 4).alias("share"))


def concentration_edges(tenders: DataFrame, *, least_share: float = 50.0, least_value: float = 1e6) -> DataFrame:
    """Award edges that hold most of what a buyer spends."""
    edges = award_edges(tenders)
    total = edges.groupBy("src").agg(F.sum("value").alias("spent")).filter(F.col("spent") >= least_value)
    return edges.join(total, "src").withColumn("share", F.round(F.col("value") * 100.0 / F.col("spent"), 4)).filter(F.col("share") >= least_share).select("src", "dst", "value", "spent", "share")


def pair_features(bidders: DataFrame) -> DataFrame:
    """Per pair of companies: tenders together, likeness of bids, share of common tenders that one of them won."""
    a = bidders.select("tender_id", F.col("company_name").alias("src"), F.col("bid_amount_mkd").alias("x"), F.col("is_winner").alias("w"))
    b = bidders.select("tender_id", F.col("company_name").alias("dst"), F.col("bid_amount_mkd").alias("y"), F.col("is_winner").alias("v"))
    like = 1 - F.try_divide(F.abs(F.col("x") - F.col("y")), F.greatest("x", "y"))
    return a.join(b, "tender_id").filter("src < dst").groupBy("src", "dst").agg(row_count().alias("together"), F.round(F.avg(like), 6).alias("bid_likeness"), F.round(F.avg((F.col("w") | F.col("v")).cast("int")), 6).alias("one_won"))


def decayed(edges: DataFrame, as_of, *, half_life_days: int = 365) -> DataFrame:
    """Edge weights halved for every ``half_life_days`` since they were last seen."""
    return edges.withColumn("weight", F.round(F.col("weight") * F.pow(F.lit(0.5), F.datediff(F.lit(as_of), "last_seen") / half_life_days), 9))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as two directed ones, parallel ones summed."""
    out = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).filter("src <> dst").groupBy(F.col("src").alias("node")).agg(row_count().alias("degree"), F.sum("weight").alias("strength"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): each edge points from the node of fewer neighbours, so no node has long lists to pair."""
    e = both_ways(edges).filter("src <> dst").select("src", "dst")
    d = e.groupBy("src").agg(row_count().alias("d"))
    ranked = e.join(d.select("src", F.struct("d", "src").alias("rs")), "src").join(d.select(F.col("src").alias("dst"), F.struct("d", F.col("src")).alias("rd")), "dst").filter("rs < rd").select("src", "dst")
    ab, ac = ranked.select(F.col("src").alias("a"), F.col("dst").alias("b")), ranked.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    wedges = ab.join(ac, "a").filter("b <> c")
    closed = wedges.join(ranked.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(row_count().alias("triangles"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, degrees, mean clustering coefficient."""
    d = degrees(edges).join(triangles(edges), "node", "left").fillna(0, ["triangles"])
    local = F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    s = d.agg(row_count().alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.round(F.stddev_pop("degree"), 6).alias("sd_degree"), F.round(F.avg(local), 6).alias("clustering"))
    parts = connected_components(edges.filter("src <> dst")).agg(F.count_distinct("component").alias("components"))
    return s.crossJoin(parts).withColumn("density", F.round(F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))), 6))  # one row each


def connected_components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, by passing labels along edges and jumping to labels' labels."""
    e = materialize(both_ways(edges).select("src", "dst"), "cc-edges")
    labels = e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
    labels = materialize(labels, "cc-labels")
    for _ in range(rounds):
        heard = e.join(labels, e["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["src"], "left").select("node", F.least("label", "heard").alias("label"))
        jump = new.select(F.col("node").alias("via"), F.col("label").alias("farther"))
        new = materialize(new.join(jump, new["label"] == jump["via"], "left").select("node", F.least("label", "farther").alias("label")), "cc-labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still move after {rounds} rounds")


def neighbourhood(edges: DataFrame, sources: DataFrame, *, hops: int = 2) -> DataFrame:
    """(source, node, depth) of all nodes within some hops of each row of ``sources`` (node)."""
    e = both_ways(edges).select("src", "dst")
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)), "hops")
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """(source, node, distance, parent) with distance 1 / max(weight, 0.001) per edge, the strongest of parallel edges.

    Goes on until no distance falls, at most as many rounds as there are nodes; an error if ``rounds`` end before that.  Each
    round follows the edges of those nodes alone whose distance fell in the one before.
    """
    e = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg((1 / F.greatest(F.max("weight"), F.lit(0.001))).alias("length"))
    e = materialize(e, "path-edges")
    best = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("moved")), "paths")
    for _ in count() if rounds is None else range(rounds):
        front = best.filter("moved").select("source", "node", "distance")
        longer = front.join(e, front["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("distance") + F.col("length")).alias("distance"), F.col("src").alias("parent"))).alias("m"))
        known = best.select("source", "node", F.struct("distance", "parent").alias("m"), F.col("distance").alias("was"))
        both = known.unionByName(longer.withColumn("was", F.lit(None).cast("double"))).groupBy("source", "node").agg(F.min("m").alias("m"), F.max("was").alias("was"))
        new = materialize(both.select("source", "node", "m.distance", "m.parent", (F.col("was").isNull() | (F.col("m.distance") < F.col("was"))).alias("moved")), "paths")
        discard(best)
        best = new
        if best.filter("moved").isEmpty():
            return best.drop("moved")
    raise RuntimeError(f"distances still fall after {rounds} rounds")


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank), ranks summing to 1; parallel edges summed, what dangling nodes hold spread evenly.

    Each round's ranks are written, and the next one's dangling mass is a sum over them.  Goes on until no rank moves by
    ``tolerance``; an error if ``rounds`` end before that.
    """
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = materialize(e.groupBy("src").agg(F.sum("weight").alias("total")), "pr-totals")
    flow = materialize(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "pr-edges")
    names = flow.select(F.col("src").alias("node")).union(flow.select("dst")).distinct()
    nodes = materialize(names.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").fillna(True, ["dangling"]), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = materialize(nodes.withColumn("rank", F.lit(1.0 / n)), "pr-ranks")
    lost, gap = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0], 1.0
    for _ in range(rounds):
        got = flow.join(ranks, flow["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        new = materialize(nodes.join(got, "node", "left").select("node", "dangling", rank.alias("rank")), "pr-ranks")
        told = new.join(ranks.select("node", F.col("rank").alias("was")), "node").agg(F.max(F.abs(F.col("rank") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        discard(ranks)
        ranks, (gap, lost) = new, told
        if gap < tolerance:
            return ranks.select("node", "rank")
    raise RuntimeError(f"ranks still move by {gap} after {rounds} rounds")


def communities(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(node, community) by label propagation until it settles: a node wants the label of most weight around it, of equals its own,
    else the smallest.

    In each round half of the nodes that want another label, by the hash of node and round, take it, so that two sides of a
    graph don't swap labels for ever; every step adds to the weight within communities.  An error if ``rounds`` end before
    no node wants another.
    """
    e = materialize(both_ways(edges).filter("src <> dst"), "lp-edges")
    labels = materialize(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label")), "lp-labels")
    for i in range(rounds):
        votes = e.join(labels, e["dst"] == labels["node"]).groupBy("src", "label").agg(F.sum("weight").alias("votes"))
        own = labels.select(F.col("node").alias("src"), F.col("label").alias("own"))
        first = votes.join(own, "src").groupBy("src", "own").agg(F.min(F.struct(-F.col("votes"), (F.col("label") != F.col("own")).alias("other"), "label"))["label"].alias("want"))
        wants = materialize(first, "lp-wants")
        if wants.filter("want <> own").isEmpty():
            return labels.withColumnRenamed("label", "community")
        turn = F.pmod(F.xxhash64("src", F.lit(i)), F.lit(2)) == 0
        new = materialize(wants.select(F.col("src").alias("node"), F.when(turn, F.col("want")).otherwise(F.col("own")).alias("label")), "lp-labels")
        discard(wants)
        discard(labels)
        labels = new
    raise RuntimeError(f"labels still move after {rounds} rounds")


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: members, inner edges, density."""
    size = members.groupBy("community").agg(row_count().alias("members"))
    a, b = members.select(F.col("node").alias("src"), F.col("community").alias("ca")), members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(row_count().alias("inner_edges"))
    density = F.when(F.col("members") > 1, F.round(2.0 * F.col("inner_edges") / (F.col("members") * (F.col("members") - 1)), 6))
    return size.join(inner, "community", "left").fillna(0, ["inner_edges"]).withColumn("density", density)


def k_core(edges: DataFrame, k: int = 2, *, rounds: int | None = None) -> DataFrame:
    """(node): what is left after nodes of fewer than k neighbours are taken away again and again, until none is; an error
    if ``rounds`` end before that."""
    e = materialize(both_ways(edges).filter("src <> dst").select("src", "dst"), "core")
    before = e.count()
    for _ in count() if rounds is None else range(rounds):
        keep = e.groupBy("src").agg(row_count().alias("d")).filter(F.col("d") >= k).select("src")
        e = materialize(e.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi"), "core")
        now = e.count()
        if now == before:
            return e.select(F.col("src").alias("node")).distinct()
        before = now
    raise RuntimeError(f"nodes still fall away after {rounds} rounds")


def drawn_pivots(edges: DataFrame, *, exact_up_to: int = 1000, draws: tuple[tuple[int, int], ...] = ((5000, 500), (1000, 200))) -> DataFrame:
    """(node): all nodes of a graph of ``exact_up_to``, else as many, in the order of their hashes, as the first of
    ``draws`` (more nodes than, pivots) says."""
    nodes = edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    if n <= exact_up_to:
        return nodes
    return nodes.orderBy(F.xxhash64("node"), "node").limit(next(k for least, k in draws if n > least))


def betweenness(edges: DataFrame, pivots: DataFrame, *, depth: int | None = None) -> DataFrame:
    """(node, score) of every node: betweenness over shortest paths from the rows of ``pivots`` (node), by Brandes'
    accumulation, times nodes by pivots.

    All pivots advance together, hop by hop, until none reaches a new node (or for ``depth`` hops, if given); dependencies
    flow back level by level.  Counts are kept as matrices of blocks of nodes (``path_counts``).
    """
    e = materialize(both_ways(edges).filter("src <> dst").select("src", "dst"), "bt-edges")
    nodes = materialize(e.select(F.col("src").alias("node")).distinct(), "bt-nodes")
    pivots = materialize(pivots.select("node").distinct().join(nodes, "node", "left_semi"), "bt-pivots")
    scale = nodes.count() / max(1, pivots.count())
    return dependencies(e, pivots, depth=depth).select("node", (F.col("score") / 2 * scale).alias("score"))


def revolving_doors(edges: DataFrame) -> DataFrame:
    """Names on both sides of award edges (src, dst, value): edges and value of each side."""
    side = lambda c, n: edges.groupBy(F.col(c).alias("name")).agg(row_count().alias(f"{n}_edges"), F.sum("value").alias(f"{n}_value"))
    return side("src", "buyer").join(side("dst", "supplier"), "name")


def rotation_clusters(tenders: DataFrame, bidders: DataFrame, *, least_tenders: int = 4, least_ratio: float = 0.3, least_score: float = 40.0) -> DataFrame:
    """Equal sets of bidders that share awards among several winners: how often the winner changes, the winners' share of the set
    as a score, and a confidence that grows with the tenders."""
    sets = bidders.groupBy("tender_id").agg(F.array_join(F.sort_array(F.collect_set("company_name")), "|").alias("companies"), F.count_distinct("company_name").alias("n")).filter("n >= 2")
    awards = won(tenders).select("tender_id", "winner", "publication_date").join(sets, "tender_id")
    w = Window.partitionBy("companies").orderBy("publication_date", "tender_id")
    seq = awards.withColumn("changed", (F.col("winner") != F.lag("winner").over(w)).cast("int"))
    per = seq.groupBy("companies").agg(row_count().alias("tenders"), F.count_distinct("winner").alias("winners"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    ratio = F.round(F.col("changes") / F.greatest(F.col("tenders") - 1, F.lit(1)), 6)
    score = F.round(F.col("winners") * 100.0 / F.size(F.split("companies", r"\|")), 6)
    rows = per.filter((F.col("tenders") >= least_tenders) & (F.col("winners") >= 2)).withColumns({"ratio": ratio, "score": score}).filter((F.col("ratio") > least_ratio) & (F.col("score") >= least_score))
    return rows.withColumn("confidence", F.least(F.lit(100.0), F.col("score") + F.col("tenders") * 2))


def cover_clusters(bidders: DataFrame, *, least_ratio: float = 1.1, least: int = 3, least_mean: float = 1.15, most_sd: float = 0.3) -> DataFrame:
    """(winner, loser) pairs whose losing bids lie steadily above the winning ones."""
    winners = bidders.filter("is_winner and bid_amount_mkd > 0").select("tender_id", F.col("company_name").alias("winner"), F.col("bid_amount_mkd").alias("won_at"))
    ratio = bidders.filter("not is_winner").join(winners, "tender_id").withColumn("ratio", F.col("bid_amount_mkd") / F.col("won_at")).filter(F.col("ratio") > least_ratio)
    per = ratio.groupBy("winner", F.col("company_name").alias("loser")).agg(row_count().alias("n"), F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"))
    return per.filter((F.col("n") >= least) & (F.col("mean") > least_mean) & (F.col("sd") < most_sd)).select("winner", "loser", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def market_allocation(tenders: DataFrame, *, least_wins: int = 2) -> DataFrame:
    """(category, winner, buyers, rivals, met, never_met): companies that win repeatedly in a category, how many others do, and with
    how many of them a company never shares a buyer.  Those that it does are found through buyers; the rest is only counted.

    Companies of a category with the same buyers meet the same others, so sets of buyers meet instead, each with the number
    of its companies; two sets meet at the first buyer that both hold, and pairs are summed where they are made.
    """
    wins = won(tenders).filter("category is not null").groupBy("category", "procuring_entity", "winner").agg(row_count().alias("n"))
    per = wins.groupBy("category", "winner").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("procuring_entity")).alias("held")).filter(F.col("n") >= least_wins)
    per = materialize(per.select("category", "winner", "held", F.size("held").cast("long").alias("buyers")), "repeated-winners")
    sets = materialize(per.groupBy("category", "held").agg(row_count().alias("companies")), "buyer-sets")
    one = sets.select("category", "held", F.explode("held").alias("buyer"))
    other = sets.select("category", F.col("held").alias("held_too"), "companies", F.explode("held").alias("buyer"))
    first = F.col("buyer") == F.array_min(F.array_intersect("held", "held_too"))
    met = one.join(other, ["category", "buyer"]).filter(first).groupBy("category", "held").agg((F.sum("companies") - 1).alias("met"))
    size = per.groupBy("category").agg((row_count() - 1).alias("rivals"))
    out = per.join(size, "category").join(met, ["category", "held"], "left").fillna(0, ["met"]).filter("rivals > 0")
    return out.select("category", "winner", "buyers", "rivals", "met", (F.col("rivals") - F.col("met")).alias("never_met"))
