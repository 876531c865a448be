"""Shortest paths from many nodes at once, counted block by block.

Nodes are dealt into blocks and numbered there, sources into groups.  What a group knows of a block is one row with a
small matrix (nodes x sources), and the edges between two blocks are one row of numbers.  A hop multiplies the two, so that what
is shuffled is matrices, never a row for each source and edge; sums over the blocks that reach another are added where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidscope.workspace import discard, materialize

_STATE = "grp int, block int, n int, m int, level binary, paths binary, gain binary, moved boolean"
_MATRIX = "grp int, block int, onto int, n int, m int, x binary"
_AT_ONCE = 100_000


def _batch(schema: pa.Schema | list[str], rows: list[tuple]) -> pa.Table:
    types = {"level": pa.binary(), "paths": pa.binary(), "gain": pa.binary(), "x": pa.binary(), "s": pa.binary(), "d": pa.binary(), "moved": pa.bool_(), "place": pa.int32(), "score": pa.float64()}
    return pa.table({name: pa.array([r[i] for r in rows], types.get(name, pa.int32())) for i, name in enumerate(schema)})


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _matrix(raw: bytes, n: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1)


def _pack(edges: pa.Table) -> pa.Table:
    """One row of a pair of blocks: numbers of the edges' ends, in the order of the ends reached."""
    s, d = (edges.column(c).to_numpy().astype(np.int32) for c in ("s", "d"))
    order = np.lexsort((s, d))
    return _batch(["block", "onto", "s", "d"], [(edges.column("block")[0].as_py(), edges.column("onto")[0].as_py(), s[order].tobytes(), d[order].tobytes())])


def _product(edges: pa.Table, given: pa.Table) -> pa.Table:
    """Sums over the edges of two blocks, for each group of sources; (grp, block: the one reached, onto: the one left)."""
    out = []
    for e in edges.to_pylist():
        s, d = np.frombuffer(e["s"], np.int32), np.frombuffer(e["d"], np.int32)
        for i in range(given.num_rows):
            r = {c: given.column(c)[i].as_py() for c in given.column_names}
            x = _matrix(r["x"], r["n"])
            live = x.any(axis=1)[s]
            via, to = s[live], d[live]
            if not len(to):
                continue
            total = np.zeros((int(to[-1]) + 1, x.shape[1]))
            for a in range(0, len(to), _AT_ONCE):
                v, t = via[a : a + _AT_ONCE], to[a : a + _AT_ONCE]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                total[t[first]] += np.add.reduceat(x[v], first, axis=0)
            out.append((r["grp"], e["onto"], e["block"], len(total), r["m"], total.tobytes()))
    return _batch(_names(_MATRIX), out)


def _updated(change: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A group's block with the sums that reached it; ``change(level, paths, gain, sums)`` gives the three matrices and if any moved."""

    def run(state: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        for r in state.to_pylist():
            total = np.zeros((r["n"], r["m"]))
            for s in sorted(sums.to_pylist(), key=lambda s: s["onto"]):  # in one order, so that reruns agree
                total[: s["n"]] += _matrix(s["x"], s["n"])
            level, paths, gain, moved = change(_matrix(r["level"], r["n"], np.int32), _matrix(r["paths"], r["n"]), _matrix(r["gain"], r["n"]), total)
            out.append((r["grp"], r["block"], r["n"], r["m"], level.tobytes(), paths.tobytes(), gain.tobytes(), moved))
        return _batch(_names(_STATE), out)

    return run


def _sent(state: DataFrame, links: DataFrame, message: Callable) -> DataFrame:
    """What each block sends, ``message(level, paths, gain)``, once for each block that it has edges to; nothing for zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                x = message(_matrix(r["level"], r["n"], np.int32), _matrix(r["paths"], r["n"]), _matrix(r["gain"], r["n"]))
                if x.any():
                    yield from _batch(_names(_MATRIX), [(r["grp"], r["block"], 0, r["n"], r["m"], np.ascontiguousarray(x, float).tobytes())]).to_batches()

    given = state.mapInArrow(run, _MATRIX).drop("onto")
    return given.join(F.broadcast(links), "block").select(*_names(_MATRIX))  # a row per pair of blocks


def _hop(state: DataFrame, edges: DataFrame, links: DataFrame, message: Callable, change: Callable) -> DataFrame:
    sent = _sent(state, links, message)
    sums = edges.groupBy("block", "onto").cogroup(sent.groupBy("block", "onto")).applyInArrow(_product, _MATRIX)
    return materialize(state.groupBy("grp", "block").cogroup(sums.groupBy("grp", "block")).applyInArrow(_updated(change), _STATE), "path-blocks")


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            level, paths = np.full((r["n"], r["m"]), -1, np.int32), np.zeros((r["n"], r["m"]))
            for at in r["own"] or ():
                level[at["place"], at["col"]], paths[at["place"], at["col"]] = 0, 1
            yield from _batch(_names(_STATE), [(r["grp"], r["block"], r["n"], r["m"], level.tobytes(), paths.tobytes(), np.zeros_like(paths).tobytes(), True)]).to_batches()


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, block = batch.column("n")[i].as_py(), batch.column("block")[i].as_py()
            gain = np.where(_matrix(batch.column("level")[i].as_py(), n, np.int32) > 0, _matrix(batch.column("gain")[i].as_py(), n), 0.0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(gain)], names=["block", "place", "score"])


def _numbered(rows: DataFrame, groups: int, group: str, place: str) -> DataFrame:
    dealt = rows.withColumn(group, F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
    return dealt.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy("node")) - 1)


def dependencies(edges: DataFrame, sources: DataFrame, *, depth: int | None = None, least_blocks: int = 8, nodes_each: int = 16_384, sources_each: int = 48) -> DataFrame:
    """(node, score): for every node the sum, over the shortest paths from each row of ``sources`` (node), of the share of
    paths that pass it, by Brandes' accumulation.  ``edges`` are (src, dst), each both ways and once; sources are nodes.
    """
    names = edges.select(F.col("src").alias("node")).distinct()
    n, m = names.count(), sources.count()
    blocks = max(1, -(-n // nodes_each), min(least_blocks, -(-n // 64)))
    nodes = materialize(_numbered(names, blocks, "block", "place"), "path-nodes")
    asked = _numbered(sources.select("node"), max(1, -(-m // sources_each)), "grp", "col")
    ends = lambda c, block, place: nodes.select(F.col("node").alias(c), F.col("block").alias(block), F.col("place").alias(place))
    between = edges.join(ends("src", "block", "s"), "src").join(ends("dst", "onto", "d"), "dst").select("block", "onto", "s", "d")
    packed = materialize(between.groupBy("block", "onto").applyInArrow(_pack, "block int, onto int, s binary, d binary"), "path-edges")
    links = packed.select(F.col("block").alias("block"), F.col("onto").alias("onto"))  # columns of its own
    own = asked.join(nodes, "node").groupBy("grp", "block").agg(F.collect_list(F.struct("place", "col")).alias("own"))
    sized = nodes.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("n")).crossJoin(asked.groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("m")))  # blocks by groups
    state = materialize(sized.join(own, ["grp", "block"], "left").select("grp", "block", "n", "m", "own").mapInArrow(_begun, _STATE), "path-blocks")
    hops = 0
    while depth is None or hops < depth:
        at = hops

        def reach(level, paths, gain, sums, at=at):
            new = (level < 0) & (sums > 0)
            return np.where(new, np.int32(at + 1), level).astype(np.int32), np.where(new, sums, paths), gain, bool(new.any())

        was, state = state, _hop(state, packed, links, lambda level, paths, gain, at=at: np.where(level == at, paths, 0.0), reach)
        discard(was)
        if state.filter("moved").isEmpty():
            break
        hops += 1
    for at in range(hops, 0, -1):

        def back(level, paths, gain, sums, at=at):
            return level, paths, np.where(level == at - 1, paths * sums, gain), True

        was, state = state, _hop(state, packed, links, lambda level, paths, gain, at=at: np.where(level == at, (1 + gain) / np.maximum(paths, 1), 0.0), back)
        discard(was)
    per = state.select("block", "n", "level", "gain").mapInArrow(_scored, "block int, place int, score double").groupBy("block", "place").agg(F.sum("score").alias("score"))
    return nodes.join(per, ["block", "place"], "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
