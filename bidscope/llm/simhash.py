"""SimHash near-duplicates, found with Golay-code keys.

Fingerprints are 64-bit majorities of the XXH64 hashes of three-word shingles.  Two link if at most three bits differ.
A fingerprint falls into three segments of 22, 21 and 21 bits, each a word of the perfect (23, 12) Golay code's space.
Decoding a segment gives the index of the nearest codeword; the indices of the segment and of all its one-bit neighbours
are its ball (one to six of them).  Where two segments differ in one bit, either's index lies in the other's ball.
Three errors over three segments leave, by the pigeonhole principle, one of these cases, each with its keys:

* two segments equal: the two segments as they are;
* one equal, another within one bit: the equal segment with an index of the other, own on one side, the ball on the other;
* all within one bit: the three indices, the ball taken for the first and third on one side, for the second on the other.

Rows that share a key are compared bit for bit inside the task that holds them, and each task sends on no more links
than join its fingerprints up, never all pairs.  A key that more than ``MOST_HELD`` distinct fingerprints share is not
held by a task: the bits in which they differ are cut into four parts, of which one at least is equal in two that link,
and each part's value together with the key is a key of the next round.  Components follow from the links by distributed
star contraction.

Defined results: a null text is an empty one; a text without words has fingerprint zero, one of fewer than three words
has one shingle; equal fingerprints are one class; a null doc_id never is a component's id unless all of it are null; an
empty table gives no rows; other input columns are ignored (and kept by ``drop_near_copies``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.llm.common import free_name, mix64, row_hash
from bidscope.workspace import discard, materialize, release_shuffles

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
#: Distinct fingerprints of one key that a task holds and compares.
MOST_HELD = 1 << 15
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_GAP = re.compile(rb"[\x20\x09-\x0D]+")


# --- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    joined = _GAP.sub(b" ", text.lower()).strip(b" ")
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < shingle_words:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *(gaps + 1).tolist()][: len(gaps) + 2 - shingle_words]
        ends = [*gaps.tolist(), len(joined)][shingle_words - 1 :]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    values = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 14):
        counts += np.unpackbits(values[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, fp[, row]): the fingerprint as a signed long, and a string that tells the row apart if there is one."""
    named = ["row"] if row is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *named])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[row.alias(n) for n in named])
    return read.mapInArrow(run, "doc_id long, fp long" + ", row string" * len(named))


# --- the Golay code ---------------------------------------------------------------------------------------------------


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word: remainders on division by the generator."""

    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    unit = [rest(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for i in range(12):
        low ^= np.where(np.arange(1 << 12) >> i & 1, np.uint32(unit[i]), np.uint32(0)).astype(np.uint32)
    for i in range(11):
        high ^= np.where(np.arange(1 << 11) >> i & 1, np.uint32(unit[12 + i]), np.uint32(0)).astype(np.uint32)
    return low, high


class Golay:
    """Decoder of 23-bit words to the 12-bit index of the nearest codeword, at most three bits away."""

    def __init__(self) -> None:
        self.low, self.high = _remainders()
        self.error = np.zeros(1 << 11, np.uint32)
        bits = [1 << i for i in range(23)]
        patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        p = np.array(patterns, np.uint32)
        self.error[self._syndrome(p)] = p

    def _syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[v >> np.uint32(12)]

    def index(self, v: np.ndarray) -> np.ndarray:
        """The code is systematic in its high 12 bits, so these name the codeword."""
        return (v ^ self.error[self._syndrome(v)]) >> np.uint32(11)

    def ball(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the distinct indices of each word and its neighbours within the lowest ``bits`` bits."""
        near = np.stack([self.index(v)] + [self.index(v ^ np.uint32(1 << b)) for b in range(bits)], 1)
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, _ = np.nonzero(new)
        return row, near[new]


def fingerprint_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each of the unsigned 64-bit fingerprints."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    own = [code.index(s) for s in seg]
    ball = [code.ball(s, bits) for s, (_, bits) in zip(seg, SEGMENTS, strict=True)]
    everyone = np.arange(len(fps))
    rows, keys = [], []

    def put(table: int, row: np.ndarray, *parts: tuple[np.ndarray, int]) -> None:
        key = np.full(len(row), table, np.uint64)
        for value, bits in parts:
            key = key << np.uint64(bits) | value.astype(np.uint64)
        rows.append(row)
        keys.append(key)

    table = 0
    for a, b in ((0, 1), (0, 2), (1, 2)):
        put(table, everyone, (seg[a], 22), (seg[b], 22))
        table += 1
    for a in range(3):
        for b in range(3):
            if a != b:
                put(table, everyone, (seg[a], 22), (own[b], 12))
                row, index = ball[b]
                put(table, row, (seg[a][row], 22), (index, 12))
                table += 1
    # First and third by ball, second as it is; and the other way round.
    row0, index0 = ball[0]
    row2, index2 = ball[2]
    n2 = np.bincount(row2, minlength=len(fps))
    first2 = np.concatenate([[0], np.cumsum(n2)[:-1]]).astype(np.int64)
    times = n2[row0]
    row = np.repeat(row0, times)
    within = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(row) else np.zeros(0, np.int64)
    put(table, row, (np.repeat(index0, times), 12), (own[1][row], 12), (index2[first2[row] + within], 12))
    row1, index1 = ball[1]
    put(table, row1, (own[0][row1], 12), (index1, 12), (own[2][row1], 12))
    return np.concatenate(rows), np.concatenate(keys)


# --- links --------------------------------------------------------------------------------------------------------------


def _forest(values: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that join up distinct fingerprints as all links of at most ``most_bits`` bits do: fewer than there are values.

    A walk over the links: each value is compared once with those not reached yet.
    """
    left, links = np.arange(len(values)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= most_bits
            new = left[near].tolist()
            links += [(at, x) for x in new]
            reached += new
            left = left[~near]
    return links


def _compared(keyed: DataFrame, most_bits: int, most_held: int) -> DataFrame:
    """Rows (key, src, dst) from rows (key, fp), sorted by key and fp in each task: links with a null key, and the
    fingerprints (src) of keys that are too full for a task, without dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, overfull = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            src, dst = [], []
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.r_[cut, len(keys)])
            pair = cut[size == 2]
            x, y = fps[pair], fps[pair + 1] if len(pair) else fps[pair]
            near = (np.bitwise_count(x ^ y) <= most_bits) & (x != y)
            src.append(x[near])
            dst.append(y[near])
            for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                values = np.unique(fps[at : at + n])
                if len(values) > 1:
                    found = np.array(_forest(values, most_bits), np.int64).reshape(-1, 2)
                    src.append(values[found[:, 0]])
                    dst.append(values[found[:, 1]])
            a, b = (np.concatenate(c).view(np.int64) for c in (src, dst))
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "src", "dst"])

        def left_over(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.nulls(len(keys), pa.int64())], names=["key", "src", "dst"])

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if overfull is not None:  # the rest of a key whose first rows went on already
                rest = int(np.searchsorted(keys, overfull, "right"))
                yield left_over(keys[:rest], fps[:rest])
                keys, fps = keys[rest:], fps[rest:]
                if len(keys):
                    overfull = None
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.r_[cut, len(keys)])
            full = np.repeat(size > most_held, size)
            last = np.arange(len(keys)) >= (cut[-1] if len(cut) else 0)  # the last key may go on in the next batch
            yield links(keys[~full & ~last], fps[~full & ~last])
            if full.any():
                yield left_over(keys[full], fps[full])
            if len(full) and full[-1]:
                overfull = keys[-1]
            held_keys, held = keys[last & ~full], fps[last & ~full]
        yield links(held_keys, held)

    return keyed.mapInArrow(run, "key long, src long, dst long")


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, differ) to four rows (key, fp): the key with each quarter of the bits in ``differ``."""
    for batch in batches:
        key, fp, differ = (c.to_numpy().view(np.uint64) for c in batch.columns)
        rank, bits = np.zeros(len(fp), np.int64), np.bitwise_count(differ).astype(np.int64)
        part = np.zeros((4, len(fp)), np.uint64)
        for b in range(64):
            bit = np.uint64(1) << np.uint64(b)
            on = (differ & bit) != 0
            of = np.minimum(3, rank * 4 // np.maximum(1, bits))
            for k in range(4):
                part[k] |= np.where(on & (of == k), fp & bit, np.uint64(0))
            rank += on
        for k in range(4):
            named = mix64(mix64(key + np.uint64(k + 1)) ^ part[k])
            yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])


def links_of(keyed: DataFrame, most_bits: int = MOST_BITS, most_held: int = MOST_HELD) -> DataFrame:
    """(src, dst): links between distinct fingerprints that share a key, from rows (key, fp); each row once.

    Keys too full for a task go into another round under narrower keys.  Each round a quarter of the differing bits is
    fixed, so after a few a key has too few bits left to be full, whatever the fingerprints are.
    """
    if most_bits > 3:
        raise ValueError("the keys find links of up to three bits")
    found, rounds = None, 0
    while True:
        compared = materialize(_compared(keyed.repartition("key").sortWithinPartitions("key", "fp"), most_bits, most_held), "compared")
        links = compared.filter("key is null").select("src", "dst")
        found = links if found is None else found.unionByName(links)
        full = compared.filter("key is not null").select("key", F.col("src").alias("fp"))
        rounds += 1
        if full.isEmpty():
            return found.distinct()
        if rounds > 16:
            raise RuntimeError("keys are too full still")
        differ = full.groupBy("key").agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("differ"))
        differ = materialize(differ, "full-keys")  # a table of its own, so that Spark can split a full key in the join
        keyed = full.join(differ, "key").select("key", "fp", "differ").mapInArrow(_narrower, "key long, fp long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches, roots themselves left out, by large-star and small-star steps.

    Each step is an aggregation and a join of the links; their number never grows, and settles after about the
    logarithm of the longest chain.
    """
    edges = materialize(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The aggregated sides are written before the joins, so that Spark can split a node of very many links there.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m")), "low")
        large = materialize(both.join(low, both["u"] == low["c"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        # Small star: to the least smaller neighbour, the node itself and its other smaller neighbours.
        least = materialize(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "least")
        moved = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        settled = materialize(moved.filter("u <> v").distinct(), "links")
        for table in (edges, low, large, least):
            discard(table)
        edges = settled
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _component_roots(marked: DataFrame, most_bits: int) -> DataFrame:
    """(fp, first_id, root): the component of each distinct fingerprint, and the smallest doc_id that has it."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 2048):
                part = fps[i : i + 2048]
                row, key = fingerprint_keys(part, code)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(key_rows, "key long, fp long")  # a fingerprint's keys are all different
    joined = components(links_of(keyed, most_bits))
    return distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, *, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    release_shuffles(docs.sparkSession)
    marked = materialize(fingerprints(docs), "simhash")
    per_fp = materialize(_component_roots(marked, most_bits), "roots")
    named = materialize(per_fp.groupBy("root").agg(F.min("first_id").alias("component_id")), "root-ids")
    member = materialize(per_fp.join(named, "root").select("fp", "component_id"), "members")
    return marked.join(member, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, *, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows that stay, one of each component, with all their columns: that with the smallest doc_id, ids that are
    null coming after all others, and of equal ids that with the smallest hash.  Rows are told apart by a hash of id and
    text together, so components whose rows share an id, or have none, keep a row each."""
    release_shuffles(docs.sparkSession)
    row, mark, n = row_hash("doc_id", "text"), free_name(docs, "__row"), free_name(docs, "__n")
    marked = materialize(fingerprints(docs, row), "simhash")
    # A row per fingerprint before the join, so that a hot fingerprint is one row there.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    each = materialize(marked.groupBy("fp").agg(first), "simhash-first")
    kept = each.join(_component_roots(marked, most_bits), "fp").groupBy("root").agg(F.min("first")["row"].alias(mark)).select(mark)
    number = F.row_number().over(Window.partitionBy(mark).orderBy(F.xxhash64(*docs.columns)))
    return docs.withColumn(mark, row).join(kept, mark).withColumn(n, number).filter(F.col(n) == 1).select(docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
