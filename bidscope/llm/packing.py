"""Packing documents into token windows by best-fit decreasing.

A document's ids, closed by the end id, are cut into full windows from its start; what is left over, always less than a
window, is packed with other documents' rests: longest first, each into the open window with the least room that still
takes it.  Open windows stand in a segment tree over their remaining room, so a piece finds its window in steps of the
logarithm of the window size.  Documents are dealt into groups of about ``rows_each`` by a hash of their ids, and each
group packs its own rests, so only piece lengths are ever shuffled.  A group that has many more pieces than others, where
very many rows share an id or have none, is dealt out again row by row, so no group grows with the corpus.

Defined results: a null or empty text is the end id alone; repeated rows are packed as documents of their own; a null
doc_id is kept; an empty table gives no rows; other input columns are ignored.  A sequence is padded to the window unless
its length is a power of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import partitions_for
from bidscope.workspace import materialize, release_shuffles

WINDOW = 1024
END_ID = 0
CACHED_WORDS = 400_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, sequence_tokens long, padded_tokens long"


class WindowTree:
    """Open windows by remaining room: a segment tree that counts the windows below each node."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of a window with the least room of at least ``need``; it leaves the tree."""
        count, node = self.count, self.leaves + need
        if node >= 2 * self.leaves:
            return None
        if not count[node]:
            while node > 1:  # up to the first right sibling that has a window, then down its left side
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            else:
                return None
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.open[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, window


def best_fit(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(window, offset) of each piece, and how full each window is.  Takes pieces in the order given."""
    tree, used, placed = WindowTree(capacity), [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found = (capacity, len(used))
            used.append(0)
        room, window = found
        placed.append((window, used[window]))
        used[window] += n
        if room > n:
            tree.add(room - n, window)
    return placed, used


class Encoder:
    """Token ids of ordinary text by a byte-level BPE file of the ``tokenizers`` library.

    Such a file's ids are the ranks of its merges, so the faster rank-based encoder serves; where a probe shows that it
    doesn't give the library's own ids, the library encodes.  Words that a single space joins are encoded one by one
    and remembered.
    """

    PROBE = "The 3 dogs' barks, it's—naïve… straße  \n\n x\ty <|endoftext|> ÀÉ 日本 12345!?"

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.ranked = self._ranked(json.loads(spec))
        self.cached_words, self.cache = cached_words, {}
        if self.ranked and self.ranked(self.PROBE) != self.library.encode(self.PROBE, add_special_tokens=False).ids:
            self.ranked = None

    @staticmethod
    def _ranked(spec: dict):
        try:
            import public_tokenizers
            import tiktoken

            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
            others = [b for b in range(256) if b not in set(plain)]
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
            special = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
            return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        except (ImportError, AttributeError, KeyError, ValueError):
            return None

    def _encode(self, text: str) -> bytes:
        ids = self.ranked(text) if self.ranked else self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.ranked is None:
            return self._encode(text)
        words = text.split(" ")
        # A space before white space belongs to it, so only single spaces between other characters part a text safely.
        if len(words) < 4 or text[-1:].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            return self._encode(text)
        cache, out = self.cache, []
        if len(cache) > self.cached_words:
            cache.clear()
        first = True
        for w in words:
            if first:
                first = False
                out.append(self._encode(w))
                continue
            got = cache.get(w)
            if got is None:
                got = self._encode(f" {w}")
                if len(w) <= 40:
                    cache[w] = got
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows and the rest of each document, without their ids: (doc_id, start, length, ids_crc32, doc_tokens)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer())
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end if text else end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, x in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, groups: int, *, window: int = WINDOW, most_pieces: int = 65536) -> DataFrame:
    """Give every piece a sequence and its place there; each of ``groups`` packs by itself.

    A group of more than ``most_pieces`` is split into parts of about a quarter of that; so no task holds more.
    """

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        group = table.column("grp")[0].as_py()
        length = table.column("length").to_numpy()
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_numpy()
        placed, used = best_fit(length[order].tolist(), window)
        seq, off = np.empty(n, np.int64), np.empty(n, np.int64)
        at = np.array(placed, np.int64).reshape(n, 2)
        seq[order], off[order] = at[:, 0], at[:, 1]
        full = np.array(used, np.int64)[seq]
        padded = np.where(full & (full - 1) == 0, full, window)
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        for name, column in (("sequence_id", (np.int64(group) << 32) + seq), ("offset", off), ("sequence_tokens", full), ("padded_tokens", padded)):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out

    # Full windows need no partner; a document's own windows are spread too, so a very long one makes no large group.
    # Rows without an id are dealt by what they hold.
    key = [F.coalesce("doc_id", "ids_crc32"), F.floor(F.col("start") / (256 * window))]
    dealt = materialize(pieces.withColumn("grp", F.pmod(F.xxhash64(*key), F.lit(groups)).cast("long")), "pieces")
    parts = dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_pieces).select("grp", F.ceil(F.col("n") * 4 / most_pieces).alias("parts"))
    parts = materialize(parts, "full-groups")  # a table of its own, so that Spark can split a full group in the join
    split = dealt.withColumn("row", F.monotonically_increasing_id()).join(parts, "grp", "left")
    number = F.col("grp") + groups * F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))
    return split.withColumn("grp", number).drop("row", "parts").groupBy("grp").applyInArrow(pack, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, rows_each: int = 8192) -> DataFrame:
    release_shuffles(docs.sparkSession)
    groups = partitions_for(docs.count(), rows_each)
    return pack_pieces(pieces_of(docs, tokenizer=tokenizer, window=window, end_id=end_id), groups, window=window)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
