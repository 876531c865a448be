"""Removal of repeated passages, exact to the byte, by hash-compared suffix sorting.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id.

1. Anchors.  In every 50-byte string the 20-byte string with the least hash (the leftmost, if several) is its anchor;
   equal strings have equal anchors at the same place.  Neighbouring strings mostly share one, so there are about two
   anchors per 32 bytes.  Their hashes are dealt out by value, and each document learns which of its own also occur in
   another document.  Within a block of documents copies are found at once and sent once, so an anchor that a third of
   all documents have is sent once per block, not once per document.
2. Fragments.  The bytes under all strings of one such anchor form a fragment.  Of equal fragments of a block one goes on
   for all, as rows are combined before a shuffle.  The suffixes of all fragments of an anchor are sorted: prefix polynomial
   hashes give the common extension of two suffixes by binary search, merging runs takes logarithmically many such
   comparisons, and neighbours are checked byte for byte afterwards.  Equal 50-byte prefixes then lie together, and the
   smallest doc_id of each such class decides about its strings, in every row that has them.  An anchor that very many documents share would
   gather a different fragment of each where a passage begins or ends; of such an anchor the 50-byte strings themselves are
   dealt out by their hashes, so equal ones still meet and no task holds all of its fragments.
3. The runs so found are joined to their documents and cut out.

Defined results: a null text is an empty one; a document never repeats itself, nor do rows with the same doc_id repeat
one another; a null doc_id counts as larger than every other (a table that has null, the least and the greatest
64-bit id raises ValueError); texts under 50 bytes stay whole; an empty table gives no
rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import NULL_ID, mix64, partitions_for
from bidscope.workspace import materialize, release_shuffles

MATCH_BYTES = 50
ANCHOR_BYTES = 20
HASH_BITS = 48
#: Bytes whose anchors are found in one array operation, and bytes of documents that are settled as one block.
PIECE_BYTES = 1 << 17
BLOCK_BYTES = 1 << 24
#: Bytes of fragments whose suffixes are sorted together; fragments of one anchor always are.
SORT_BYTES = 1 << 20
LEAST_BUCKETS = 8
#: An anchor that more documents share is split: its 50-byte strings are dealt out one by one.
MOST_FRAGMENTS = 1 << 14

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


# --- anchors ------------------------------------------------------------------------------------------------------------


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``width`` bytes, joined from those of powers of two."""
    h, w = _BYTE[data], 1
    out, done = None, 0
    pow_of = lambda k: np.uint64(pow(int(_BASE), k, 1 << 64))
    while True:
        if width & w:
            if out is None:
                out, done = h, w
            else:  # the part so far, then w bytes more
                n = len(data) - done - w + 1
                out, done = out[:n] * pow_of(w) + h[done : done + n], done + w
        if 2 * w > width:
            return out
        h = h[: len(h) - w] * pow_of(w) + h[w:]
        w *= 2


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, match: int = MATCH_BYTES, width: int = ANCHOR_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, strings): for each run of 50-byte strings with one anchor its hash, the first string's place and how many.

    ``starts`` and ``ends`` bound the texts that lie one after another in ``data``; strings that cross them don't count.
    """
    n = len(data) - match + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0:
        return none
    h = mix64(_rolling(data, width))
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, w = match - width + 1, 1
    low = packed
    while 2 * w <= span:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    low = np.minimum(low[:n], low[span - w : span - w + n])
    edge = np.zeros(n + 1, np.int32)  # strings that start in the last bytes of a text cross its end
    np.add.at(edge, np.minimum(np.maximum(starts, ends - match + 1), n), 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    if not len(at):
        return none
    own = low[at]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    place = (own[new] & _PLACE).astype(np.int64)
    return mix64(h[place] + np.uint64(1)) >> np.uint64(64 - HASH_BITS), at[new], np.diff(np.r_[new, len(at)])


class Block:
    """Documents side by side: their ids, and the bytes of those that can hold a match."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, text: bytes) -> None:
        self.rows.append((*row, text))
        self.size += len(text) + 64

    def anchors(self) -> Iterator[tuple]:
        """Pieces as (bytes, row, hash, first, strings, offset); first + offset is the place in the row's text."""
        piece: list[tuple[int, int, bytes]] = []
        held = 0
        for i, row in enumerate(self.rows):
            text = row[-1]
            if len(text) < MATCH_BYTES:
                continue
            for at in range(0, len(text) - MATCH_BYTES + 1, PIECE_BYTES):
                part = text[at : at + PIECE_BYTES + MATCH_BYTES - 1]
                piece.append((i, at, part))
                held += len(part)
                if held >= PIECE_BYTES:
                    yield self._piece(piece)
                    piece, held = [], 0
        if piece:
            yield self._piece(piece)

    @staticmethod
    def _piece(piece: list[tuple[int, int, bytes]]) -> tuple:
        data = np.frombuffer(b"".join(p[2] for p in piece), np.uint8)
        ends = np.cumsum([len(p[2]) for p in piece])
        starts = np.r_[0, ends[:-1]]
        h, first, strings = anchors(data, starts, ends)
        which = np.searchsorted(ends, first, "right")
        row = np.array([p[0] for p in piece], np.int64)[which]
        offset = (np.array([p[1] for p in piece], np.int64) - starts)[which]
        return data, row, h, first, strings, offset


def _arrays(column: pa.Array) -> list[np.ndarray | None]:
    """A list column as arrays that share its memory."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] if valid else None for a, b, valid in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    """Rows (key columns..., text) of a task as blocks."""
    block = Block()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):  # never a second copy of a whole batch
            batch = whole.slice(at, 256)
            columns = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns[:-1]]
            for *row, text in zip(*columns, batch.columns[-1].cast(pa.binary()).to_pylist(), strict=True):
                block.add(tuple(row), text or b"")
                if block.size > block_bytes:
                    yield block
                    block = Block()
    if block.rows:
        yield block


def _planes(x: np.ndarray) -> bytes:
    """Numbers as bytes of one weight after another, which compress better in a shuffle."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


_MEET = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("known", pa.binary())])


def _spread(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Negative buckets for rows that only pass through."""
    return (-1 - (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)).astype(np.int32)


def _meet_rows(batches: Iterator[pa.RecordBatch], buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each block and bucket the anchors of the block, each once, with a document that asks or, if the block has
    several, a mark; and what the block knows by itself, as rows (doc_id, hash)."""
    for block in _blocks(batches, block_bytes):
        found = [(h, row) for _, row, h, _, _, _ in block.anchors()]
        if not found:
            continue
        h = np.concatenate([f[0] for f in found]).astype(np.int64)
        doc = np.array([r[0] for r in block.rows], np.int64)[np.concatenate([f[1] for f in found])]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[keep], doc[keep]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        known = np.repeat(size > 1, size)
        n = int(known.sum())
        yield pa.RecordBatch.from_arrays([pa.array(_spread(doc[known], buckets)), pa.array(doc[known]), pa.array(h[known]), *[pa.nulls(n, pa.binary())] * 3], schema=_MEET)
        h1, asks, told = h[first], doc[first], size > 1  # told: nobody asks, the block knows already
        bucket = (h1 % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        out: list[list] = [[], [], [], []]
        for part in np.split(order, cut[1:]):
            out[0].append(int(bucket[part[0]]))
            out[1].append(_planes(np.diff(h1[part], prepend=0)))
            out[2].append(_planes(asks[part]))
            out[3].append(told[part].tobytes())
        m = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], schema=_MEET)


def _meet(table: pa.Table) -> pa.Table:
    """(doc_id, hash): anchors of a bucket that several blocks have or one block marks, by the document that asked."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["doc_id", "hash"])
    h = np.concatenate([np.cumsum(_unplaned(x)) for x in table.column("hashes").to_pylist()])
    asks = np.concatenate([_unplaned(x) for x in table.column("docs").to_pylist()])
    told = np.frombuffer(b"".join(table.column("known").to_pylist()), bool)
    order = np.argsort(h, kind="stable")
    h, asks, told = h[order], asks[order], told[order]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[cut, len(h)])
    shared = np.repeat(size > 1, size) & ~told
    return pa.table([pa.array(asks[shared]), pa.array(h[shared])], names=["doc_id", "hash"])


# --- suffix sorting -----------------------------------------------------------------------------------------------------


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums over the first i bytes of byte x base^place, inverse powers to move a stretch back to place 0)."""
    weighted = _BYTE[data] * _powers(_BASE, len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)]), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(data))


class Suffixes:
    """Suffixes of a byte array, compared over their first ``depth`` bytes by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, depth: int = MATCH_BYTES) -> None:
        self.data, self.depth = data, depth
        # prefix[i] sums byte x base^place over the first i bytes; the hash of a stretch is the difference of its ends'
        # sums, moved back to place 0 by the inverse power.
        self.prefix, self.back = prefix_hashes(data)
        n = max(0, len(data) - depth + 1)
        self.deep = (self.prefix[depth : depth + n] - self.prefix[:n]) * self.back[:n]  # of the first ``depth`` bytes from each place
        # The eight bytes from each place as one number; past the end they count as zero.
        word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for w in (1, 2, 4):
            word = word[: len(word) - w] << np.uint64(8 * w) | word[w:]
        self.word = word

    def hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.back[at]

    def whole(self, at: np.ndarray) -> np.ndarray:
        return self.deep[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension from places a and b, up to ``depth``, by binary search over stretches' hashes."""
        most = np.minimum(self.depth, len(self.data) - np.maximum(a, b))
        low, high = np.zeros(len(a), np.int64), most
        for _ in range(self.depth.bit_length()):
            mid = (low + high + 1) // 2
            same = self.hash(a, mid) == self.hash(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Does the suffix at a come before that at b; ``or_equal`` where both begin with the same ``depth`` bytes."""
        out = or_equal.copy()
        differ = np.flatnonzero(self.whole(a) != self.whole(b))
        if len(differ):
            x, y = a[differ], b[differ]
            n = self.common(x, y)
            out[differ] = self.data[x + n] < self.data[y + n]
        return out

    def sorted(self, places: np.ndarray) -> np.ndarray:
        """Places in the order of their suffixes.  Runs start from the order of the first sixteen bytes; within equal ones
        a bottom-up mergesort merges runs by giving each suffix its rank in the neighbouring run, found by binary search."""
        heads = [self.word[places], self.word[places + 8]]
        order = np.lexsort(heads[::-1])
        places = places[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(heads[0][order]) != 0) | (np.diff(heads[1][order]) != 0)])
        size = np.diff(np.r_[cut, len(places)])
        many = np.repeat(size > 1, size)
        todo = np.flatnonzero(many)
        if not len(todo):
            return places
        seg_start = np.repeat(cut, size)[todo]
        seg_end = np.repeat(cut + size, size)[todo]
        width, longest = 1, int(size.max())
        while width < longest:
            live = seg_end - seg_start > width
            at, lo_seg, hi_seg = todo[live], seg_start[live], seg_end[live]
            run = (at - lo_seg) // width
            left = run % 2 == 0
            own = lo_seg + run * width
            other = np.where(left, own + width, own - width)
            lo, hi = np.minimum(other, hi_seg), np.minimum(other + width, hi_seg)
            base = lo.copy()
            mine = places[at]
            while True:
                open_ = lo < hi
                if not open_.any():
                    break
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) // 2
                before = self.less(places[mid], mine[k], ~left[k])  # those of the left run come first among equals
                lo[k] = np.where(before, mid + 1, lo[k])
                hi[k] = np.where(before, hi[k], mid)
            pair = np.where(left, own, own - width)
            target = pair + (at - own) + (lo - base)
            moved = places.copy()
            moved[target] = mine
            places = moved
            width *= 2
        return places

    def classes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted places, class number): equal classes have equal first ``depth`` bytes.  Neighbours' bytes are compared, so
        the order and the classes are certain whatever the hashes said."""
        places = self.sorted(places)
        before, equal = self._steps(places)
        if not (before | equal).all():  # a hash lied: sort by the bytes themselves
            rows = np.stack([self.data[places + i] for i in range(self.depth)], 1)
            places = places[np.lexsort(rows.T[::-1])]
            _, equal = self._steps(places)
        return places, np.cumsum(np.r_[0, ~equal])

    def _steps(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place and the next: do the first ``depth`` bytes come before, and are they equal."""
        before, equal = np.zeros(max(0, len(places) - 1), bool), np.ones(max(0, len(places) - 1), bool)
        for at in [*range(0, self.depth - 7, 8), self.depth - 8]:
            word = self.word[places + at]
            before |= equal & (word[:-1] < word[1:])
            equal &= word[:-1] == word[1:]
        return before, equal


# --- fragments ----------------------------------------------------------------------------------------------------------

_FRAGMENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def _packed(anchor: np.ndarray, doc: np.ndarray, version: np.ndarray, place: np.ndarray, length: np.ndarray, raw: np.ndarray) -> bytes:
    """Fragments as one compressed binary."""
    owners, owner = np.unique(np.stack([doc, version], 1), axis=0, return_inverse=True)
    head = np.array([len(anchor), len(owners)], "<i8").tobytes()
    numbers = b"".join(map(_planes, (np.diff(anchor, prepend=0), owners[:, 0], owners[:, 1], owner.reshape(-1), place, length)))
    return zstandard.ZstdCompressor(level=1).compress(head + numbers + raw.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, owners = np.frombuffer(data, "<i8", 2).tolist()
    at, columns = 16, []
    for size in (n, owners, owners, n, n, n):
        columns.append(_unplaned(data[at : at + 8 * size]))
        at += 8 * size
    anchor, doc, version, owner, place, length = columns
    return np.cumsum(anchor), doc[owner], version[owner], place, length, np.frombuffer(data, np.uint8, offset=at)


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of a byte array one after another."""
    ends = np.cumsum(length)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def _string_hashes(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of all 50-byte strings of some stretches, one stretch after another.  They depend on the bytes alone."""
    hashes = _rolling(_gathered(data, at, length), MATCH_BYTES)
    strings = length - MATCH_BYTES + 1
    begin = np.cumsum(length) - length
    return hashes[np.arange(int(strings.sum())) + np.repeat(begin - (np.cumsum(strings) - strings), strings)]


def distinct_stretches(data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """A number for each stretch, equal for equal bytes: by hash and length, then verified byte for byte."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.lexsort((length, hashes))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (length[order][1:] != length[order][:-1])]
    number = np.empty(len(start), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new][number]
    others = np.flatnonzero(first != np.arange(len(start)))
    for i in range(0, len(others), step):
        part = others[i : i + step]
        if not np.array_equal(_gathered(data, start[part], length[part]), _gathered(data, start[first[part]], length[part])):
            seen: dict[bytes, int] = {}  # a hash lied: number them by their bytes
            return np.array([seen.setdefault(data[a : a + n].tobytes(), len(seen)) for a, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
    return number


def _settled(data: np.ndarray, at: np.ndarray, length: np.ndarray, own_hash: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of some stretches go on: of equal ones those of the smallest doc_id."""
    number = distinct_stretches(data, at, length, own_hash)
    least = np.full(int(number.max()) + 1 if len(number) else 0, NULL_ID, np.int64)
    np.minimum.at(least, number, doc)
    return doc == least[number]


def _fragment_rows(batches: Iterator[pa.RecordBatch], buckets: int, block_bytes: int, hot: np.ndarray, hot_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, version, hashes, text) to fragments of shared anchors.

    Of equal fragments in the block, those of the smallest doc_id go on; the others are covered runs already, and leave
    merged, as rows of a negative bucket.  What goes on of the ``hot`` anchors does so string by string, each string a
    fragment that bears its own hash for an anchor and is dealt by it to ``hot_buckets`` more buckets.
    """
    for block in _blocks(batches, block_bytes):
        pieces, parts, base = [], [], 0
        for data, row, h, first, strings, offset in block.anchors():
            h = h.astype(np.int64)
            shared = np.zeros(len(h), bool)
            cut = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
                shared[a:b] = np.isin(h[a:b], block.rows[row[a]][2])
            length = strings[shared] + MATCH_BYTES - 1
            start = first[shared]
            prefix, back = prefix_hashes(data)
            parts.append((h[shared], row[shared], start + base, length, start + offset[shared], (prefix[start + length] - prefix[start]) * back[start]))
            pieces.append(data)
            base += len(data)
        if not parts:
            continue
        anchor, row, at, length, place, own_hash = (np.concatenate(c) for c in zip(*parts, strict=True))
        data = np.concatenate(pieces)
        doc = np.array([r[0] for r in block.rows], np.int64)[row]
        version = np.array([r[1] for r in block.rows], np.int64)[row]
        going = _settled(data, at, length, own_hash, doc)
        bucket = (anchor % buckets).astype(np.int32)
        split = np.flatnonzero(going & np.isin(anchor, hot))
        if len(split):
            strings = length[split] - MATCH_BYTES + 1
            of = np.repeat(split, strings)
            step = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
            string_at = at[of] + step
            string_hash = _string_hashes(data, at[split], length[split])
            going[split] = False
            kept = np.ones(len(at), bool)
            kept[split] = False  # their strings stand for them
            parts = [
                (anchor, string_hash.view(np.int64)), (row, row[of]), (doc, doc[of]), (version, version[of]), (at, string_at), (length, np.full(len(of), MATCH_BYTES)), (place, place[of] + step),
                (going, _settled(data, string_at, np.full(len(of), MATCH_BYTES), string_hash, doc[of])), (bucket, (buckets + mix64(string_hash) % np.uint64(hot_buckets)).astype(np.int32)),
            ]
            anchor, row, doc, version, at, length, place, going, bucket = (np.concatenate([whole[kept], string]) for whole, string in parts)
        # What a smaller doc_id of the block has: runs of one row, merged.
        done = np.flatnonzero(~going)
        if len(done):
            done = done[np.lexsort((place[done], row[done]))]
            far = np.int64(1) << 40  # rows are laid out far apart
            lo, hi = merged_runs(row[done] * far + place[done], length[done])
            of = (lo // far).astype(np.int64)
            ids, versions = (np.array([r[i] for r in block.rows], np.int64)[of] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_spread(ids, buckets)), pa.nulls(len(of), pa.binary()), pa.array(ids), pa.array(versions), pa.array(lo % far), pa.array(hi - lo)], schema=_FRAGMENT)
        some = np.flatnonzero(going)
        some = some[np.lexsort((anchor[some], bucket[some]))]
        bucket = bucket[some]
        cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
            part = some[a:b]
            blob = _packed(anchor[part], doc[part], version[part], place[part], length[part], _gathered(data, at[part], length[part]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1]), pa.array([blob], pa.binary()), *[pa.nulls(1, pa.int64())] * 4], schema=_FRAGMENT)


_RUNS = "doc_id long, version long, start long, length long"


def _covered(table: pa.Table) -> pa.Table:
    """Fragments of a bucket's anchors to runs of bytes (start, length in the document) that a smaller doc_id has too."""
    names = ["doc_id", "version", "start", "length"]
    if table.column("bucket")[0].as_py() < 0:
        return table.select(names)
    anchor, doc, version, place, length, data = (np.concatenate(c) for c in zip(*map(_unpacked, table.column("packed").to_pylist()), strict=True))
    at = np.cumsum(length) - length
    own_hash = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):  # in parts, for the memory of the prefix sums
        lo, hi = int(at[i]), int((at + length)[min(i + (1 << 16), len(at)) - 1])
        prefix, back = prefix_hashes(data[lo:hi])
        a, n = at[i : i + (1 << 16)] - lo, length[i : i + (1 << 16)]
        own_hash[i : i + (1 << 16)] = (prefix[a + n] - prefix[a]) * back[a]
    number = distinct_stretches(data, at, length, own_hash)
    n_distinct = int(number.max()) + 1
    least = np.full(n_distinct, NULL_ID, np.int64)
    np.minimum.at(least, number, doc)
    one = np.empty(n_distinct, np.int64)  # a row with each distinct fragment
    one[number] = np.arange(len(number))
    # Distinct fragments in batches of about SORT_BYTES that part no anchor.
    order = np.argsort(anchor[one], kind="stable")
    volume = np.cumsum(length[one[order]])
    last = np.r_[np.flatnonzero(np.diff(anchor[one][order])), n_distinct - 1]
    top = np.empty(n_distinct, np.int64)
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = 0
    while begin < n_distinct:
        want = (volume[begin - 1] if begin else 0) + SORT_BYTES
        end = int(last[min(np.searchsorted(volume[last], want), len(last) - 1)]) + 1
        batch = order[begin:end]
        top[batch], *found = _match(data, at[one[batch]], length[one[batch]], least[batch], batch)
        runs.append(tuple(found))
        begin = end
    # All strings of a fragment lie in classes of an id below that of the row: the row is covered whole.
    whole = doc > top[number]
    out = [[doc[whole], version[whole], place[whole], length[whole]]]
    fragment, a, n = (np.concatenate(c) for c in zip(*runs, strict=True))
    # Else the runs of such strings, which are the same for all rows left: those of the smallest doc_id.
    rows = np.flatnonzero(~whole)
    rows = rows[np.argsort(number[rows], kind="stable")]
    lo, hi = np.searchsorted(number[rows], fragment, "left"), np.searchsorted(number[rows], fragment, "right")
    times = hi - lo
    which = rows[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
    out.append([doc[which], version[which], place[which] + np.repeat(a, times), np.repeat(n, times)])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def _match(data: np.ndarray, at: np.ndarray, length: np.ndarray, owner: np.ndarray, names: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(top, name, start, length): for each distinct fragment the largest of the ids that its strings' classes begin with,
    and the runs of its strings whose classes begin with an id below its own.

    The strings of very many fragments are sorted in several passes, each over those whose hash falls to it, so the
    memory of a pass is bounded however many share an anchor.
    """
    data = _gathered(data, at, length)
    begin = np.cumsum(length) - length
    strings = length - MATCH_BYTES + 1
    piece = np.repeat(np.arange(len(at)), strings)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings) + begin[piece]
    suffixes = Suffixes(data)
    smallest = np.full(len(data), -1, np.int64)
    piece_at = np.full(len(data), -1, np.int64)
    piece_at[place] = piece
    passes = max(1, -(-len(place) // most))
    falls_to = mix64(suffixes.whole(place)) % np.uint64(passes)
    for turn in range(passes):
        ordered, label = suffixes.classes(place[falls_to == turn])
        if len(ordered):
            smallest[ordered] = np.minimum.reduceat(owner[piece_at[ordered]], np.flatnonzero(np.r_[True, np.diff(label) != 0]))[label]
    top = np.maximum.reduceat(smallest[place], np.cumsum(strings) - strings)
    hit = place[smallest[place] < owner[piece]]
    if not len(hit):
        none = np.zeros(0, np.int64)
        return top, none, none, none
    first = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(piece_at[hit]) != 0)])
    last = np.r_[first[1:], len(hit)] - 1
    k = piece_at[hit[first]]
    return top, names[k], hit[first] - begin[k], hit[last] - hit[first] + MATCH_BYTES


# --- cutting ------------------------------------------------------------------------------------------------------------

_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged_runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs that overlapping or touching runs form."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(starts[order] + lengths[order])
    new = np.r_[True, s[1:] > e[:-1]]
    first = np.flatnonzero(new)
    return s[first], e[np.r_[first[1:], len(s)] - 1]


def without_runs(text: bytes, starts: np.ndarray | None, lengths: np.ndarray | None) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, runs)."""
    if starts is None or not len(starts):
        return text, 0, 0
    a, b = merged_runs(starts, lengths)
    keep = np.r_[0, b], np.r_[a, len(text)]
    return b"".join(text[i:j] for i, j in zip(keep[0].tolist(), keep[1].tolist(), strict=True)), int((b - a).sum()), len(a)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, doc_id, asker, version, text).  ``doc_id`` is a number without nulls in the order of the ids: they move down by
    one to make room for null at the top, unless the least of all is taken.  ``asker`` stands for a row's id and text together:
    rows that share an id learn about their own anchors only, and those equal in both ask the same."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own = F.col("doc_id").cast("long")
    low, high, nulls = docs.agg(F.min(own), F.max(own), F.max(own.isNull())).first()
    shift = 0 if low == -NULL_ID - 1 else 1
    if nulls and not shift and high == NULL_ID:
        raise ValueError("no number is left that could stand for a null doc_id")
    if not nulls:
        shift = 0
    keyed = docs.select(own.alias("id"), F.coalesce(own - F.lit(shift), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    version = F.xxhash64("text")
    return keyed.select("id", "doc_id", F.xxhash64("id", version).alias("asker"), version.alias("version"), "text")


def repeated_runs(docs: DataFrame, *, bucket_bytes: int = 1 << 22, block_bytes: int = BLOCK_BYTES, most_fragments: int = MOST_FRAGMENTS) -> DataFrame:
    """(doc_id, version, start, length): runs of bytes to remove; version tells rows with one doc_id apart by text."""
    spark = docs.sparkSession
    release_shuffles(spark)
    keyed = _keyed(docs)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, partitions_for(total, bucket_bytes))
    asked = keyed.select("asker", "text").mapInArrow(lambda b: _meet_rows(b, buckets, block_bytes), "bucket int, doc_id long, hash long, hashes binary, docs binary, known binary")
    # Written before the join, so that Spark can split an id and text that very many rows share.
    shared = asked.groupBy("bucket").applyInArrow(_meet, "doc_id long, hash long")
    per_doc = materialize(shared.groupBy(F.col("doc_id").alias("asker")).agg(F.collect_list("hash").alias("hashes")), "anchors")
    flagged = keyed.join(per_doc, "asker").select("doc_id", "version", "hashes", "text")
    schema = "bucket int, packed binary, doc_id long, version long, start long, length long"
    # Anchors of so many documents that their fragments together are too many for a task: rows / most_fragments at most.
    counted = per_doc.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_fragments).collect()
    hot = np.array([r["hash"] for r in counted], np.int64)
    # A fragment has half as many strings as an anchor's bytes can be shared by, about, each of 50 bytes.
    hot_buckets = partitions_for(sum(r["n"] for r in counted) * (MATCH_BYTES - ANCHOR_BYTES) // 2 * MATCH_BYTES, bucket_bytes)
    fragments = flagged.mapInArrow(lambda b: _fragment_rows(b, buckets, block_bytes, hot, hot_buckets), schema)
    return materialize(fragments.groupBy("bucket").applyInArrow(_covered, _RUNS), "runs")


def cut_repeats(docs: DataFrame, runs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``."""
    per = materialize(runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "length")).alias("runs")), "runs-of-rows")
    joined = _keyed(docs).join(per, ["doc_id", "version"], "left").select("id", "text", "runs.start", "runs.length")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            starts, lengths = (_arrays(c) for c in batch.columns[2:])
            for doc_id, text, start, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), starts, lengths, strict=True):
                left, removed, spans = without_runs(text, start, length)
                for c, x in zip(out, (doc_id, len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    return joined.mapInArrow(cut, _CUT + ", kept binary" * with_text)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_repeats(docs, repeated_runs(docs))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
