"""Product codes of vectors: equal parts, a small codebook for each, trained by rounds of assignment and averaging in integers.

A part's nearest entry is found by equal-average search.  Entries are sorted by the sum of their components; by Cauchy and
Schwarz an entry is at least (difference of the sums)^2 / dimension away.  From the place of a part's own sum the search
goes outward on both sides, all parts of a batch step by step together, and a side ends where that bound strictly exceeds
the best distance so far, so entries just as far away are still compared and ties go to the lower index.

Vectors become integers once, in a table of their own.  A round reads it in parallel; each task returns one sum for each
part, entry and component, Spark adds these up, and only the codebooks (entries x dimension numbers) reach the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; a null vec_id is larger
than all others; rows with one vec_id are vectors of their own, ordered by their components for the first codebook; with
fewer vectors than entries the codebook is as large as their number; vectors shorter than the longest, or than the next
multiple of the number of parts, are padded with zeros; components are held within +/-2**30 / max(parts, part width), so
that no distance leaves 64 bits; a label's error that does is null; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import attach
from bidscope.workspace import materialize, release_shuffles

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64 of (parts, entries, width of a part)."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, *, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The usable rows with floor(scale x component) in ``ints``, exact for single and double precision up to 2**62."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    far = float(1 << 62)
    whole = lambda x: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), x.cast("double") * scale)))
    return vectors.filter(F.col(column).isNotNull() & ~bad).withColumn("ints", F.transform(column, whole))


def part_width(width: int, parts: int) -> int:
    return max(1, math.ceil(width / parts))


def _largest(parts: int, width: int) -> int:
    """Bound of a component, so that (2 x bound x width)^2 and parts x width x (2 x bound)^2 stay below 2**63."""
    return (1 << 30) // max(parts, width)


def cut_parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """int64 of (rows, parts, width) of a list column, padded with zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    sizes, full = np.diff(offsets), parts * width
    if len(values) != len(sizes) * full or (sizes != full).any():
        padded = np.zeros((len(sizes), full), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        padded[row, np.arange(len(values)) - offsets[row]] = values
        values = padded
    most = _largest(parts, width)
    return np.clip(values, -most, most).reshape(len(sizes), parts, width)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry by equal-average search; ties go to the lower index."""
    n, width = vectors.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    own = vectors.sum(1)
    best, index = np.full(n, np.iinfo(np.int64).max // width), np.full(n, len(entries))
    right = np.searchsorted(ordered, own)
    sides = [(np.arange(n), right, 1), (np.arange(n), right - 1, -1)]
    while any(len(rows) for rows, _, _ in sides):
        following = []
        for rows, at, step in sides:
            inside = (at >= 0) & (at < len(entries))
            rows, at = rows[inside], at[inside]
            gap = own[rows] - ordered[at]
            near = gap * gap <= best[rows] * width
            rows, at = rows[near], at[near]
            entry = order[at]
            apart = ((vectors[rows] - entries[entry]) ** 2).sum(1)
            better = (apart < best[rows]) | ((apart == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = apart[better], entry[better]
            following.append((rows, at + step, step))
        sides = following
    return index, best


def first_codebooks(ints: DataFrame, *, parts: int, entries: int, width: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; ``entries`` rows reach the driver."""
    rows = ints.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    cut = cut_parts(pa.array([r["ints"] for r in rows], pa.list_(pa.int64())), parts, width)
    return Codebooks(cut.transpose(1, 0, 2).copy())


def _refined(ints: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean."""
    parts, n_entries, width = books.entries.shape
    shared = ints.sparkSession.sparkContext.broadcast(books.entries)  # entries x dimension numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
        for batch in batches:
            cut = cut_parts(batch.column(0), parts, width)
            for p in range(parts):
                index, _ = nearest(cut[:, p], shared.value[p])
                np.add.at(sums[p], index, cut[:, p])
                counts[p] += np.bincount(index, minlength=n_entries)
        if counts.any():
            part, entry, place = np.indices(sums.shape)
            columns = [part.ravel(), entry.ravel(), place.ravel(), sums.ravel(), np.repeat(counts.ravel(), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    told = ints.select("ints").mapInArrow(run, "part long, entry long, place long, total long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(30,0)")).alias(c)
    new = books.entries.copy()
    for r in told.groupBy("part", "entry", "place").agg(wide("total"), wide("n")).collect():
        if r["n"]:
            new[r["part"], r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    shared.unpersist()
    return Codebooks(new)


def train_codebooks(ints: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a table with ``vec_id`` and ``ints``, which is read rounds + 2 times."""
    width = part_width(ints.agg(F.max(F.size("ints"))).first()[0] or 0, parts)
    books = first_codebooks(ints, parts=parts, entries=entries, width=width)
    for _ in range(rounds if books.entries.size else 0):
        books = _refined(ints, books)
    return books


def encode(ints: DataFrame, books: Codebooks, *, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep`` with ``code`` (two hexadecimal digits for each part) and ``error``, one row per row of ``ints``."""
    parts, n_entries, width = books.entries.shape
    if n_entries > 256:
        raise ValueError("two digits tell 256 entries apart at most")
    shared = ints.sparkSession.sparkContext.broadcast(books.entries)
    kept = ints.select(*keep, "ints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = cut_parts(batch.column(len(keep)), parts, width)
            index, error = np.zeros((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for p in range(parts):
                own, apart = nearest(cut[:, p], shared.value[p])
                index[:, p] = own
                error += apart
            digits = [bytes(row).hex() for row in index]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(digits, pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    schema = kept.select(*keep).schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with the integer vector that each code stands for in ``approximation``."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books.entries])
    digit = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approximation", F.concat(*[F.get(F.get(entries, F.lit(p)), digit(p)) for p in range(len(books.entries))]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    release_shuffles(spark)
    usable = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    ints = materialize(usable.select("vec_id", "label", "ints"), "vector-integers")
    books = train_codebooks(ints)
    coded = materialize(encode(ints, books, keep=("vec_id", "label")), "vector-codes")
    # A table of its own, so that Spark can split a label that many vectors share.
    errors = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    return attach(coded, errors, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Every round is a step of its own; entries are told apart by part ``p`` and index ``e``."""
    floor_mean = "CAST((SUM(x) - ((SUM(x) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT)"
    steps = [f"""
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sized AS (SELECT *, CAST(ceil(MAX(len(v)) OVER () / {PARTS}.0) AS BIGINT) AS w, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM usable),
parts AS MATERIALIZED (SELECT rid, p, list_slice(list_resize(v, w * {PARTS}, 0), p * w + 1, (p + 1) * w) AS u FROM sized, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, u FROM parts WHERE rid <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
apart{k} AS (
  SELECT rid, parts.p, e, CAST(list_sum(list_transform(list_zip(parts.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{k} b ON parts.p = b.p),
near{k} AS MATERIALIZED (SELECT rid, p, MIN(struct_pack(d := d, e := e)) AS best FROM apart{k} GROUP BY rid, p)""")
        if k < ROUNDS:
            steps.append(f"""
items{k} AS (SELECT n.p, n.best.e AS e, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM near{k} n JOIN parts ON n.rid = parts.rid AND n.p = parts.p),
means{k} AS (SELECT p, e, list(x ORDER BY i) AS u FROM (SELECT p, e, i, {floor_mean} AS x FROM items{k} GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, COALESCE(m.u, b.u) AS u FROM book{k} b LEFT JOIN means{k} m USING (p, e))""")
    steps.append(f"""
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(SUM(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY rid),
flat AS (SELECT p, e, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM book{ROUNDS}),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat)""")
    return ",".join(steps) + """
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN sized USING (rid), digest
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _op12_sql()}
