"""Fill-in-middle: a document's middle moves behind its prefix and suffix, between sentinels, batch by batch in Arrow kernels.

Texts are cut into units (a word with the white space before it, or white space at the end).  A batch goes through one
pipeline of ``pyarrow.compute``: each text becomes a list of units, the lists are flattened with the index of their text,
an ordinal within the text gives each unit its role (prefix, middle or suffix), units are filtered by role, lists are
rebuilt from how many each text has, and the pieces are joined with the sentinels.  Regular expressions run over UTF-8
bytes, where every byte of a letter beyond ASCII is no white space, and 0xFF, which UTF-8 never has, marks the ends of units.

Batches are worked on some megabytes at a time; a longer text goes block by block, cut between units, so only the text
itself and its output are held whole.  Which cuts and which form a document gets depends on its id and unit count alone.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, is plain; a null doc_id is hashed as
nothing behind the seed; repeated rows give repeated rows; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Per cent of the documents that are changed, and of these the per cent whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of text that go through the pipeline together.
AT_ONCE = 4 << 20

_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_WORD_ENDS = re.compile(rb"[^\x20\x09-\x0D][\x20\x09-\x0D]")
_END = b"\xff"
_BYTES = pa.large_binary()
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _kept_within(x: pa.Array, most: pa.Array) -> pa.Array:
    return pc.max_element_wise(pc.min_element_wise(x, most), pa.scalar(0, pa.int64()))


def cut_units(texts: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: units before number ``first``, before ``second``, and the rest."""
    units = pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\0" + _END), pattern=_END)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts, sizes = units.offsets.slice(0, len(units)).cast(pa.int64()), pc.list_value_length(units).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    role = pc.add(pc.greater_equal(ordinal, pc.take(first, parent)).cast(pa.int8()), pc.greater_equal(ordinal, pc.take(second, parent)).cast(pa.int8()))
    until = [_kept_within(first, sizes), _kept_within(second, sizes), sizes]
    pieces = []
    for k, counts in enumerate([until[0], pc.subtract(until[1], until[0]), pc.subtract(until[2], until[1])]):
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
        own = pa.ListArray.from_arrays(offsets, pc.filter(flat, pc.equal(role, pa.scalar(k, pa.int8()))))
        pieces.append(pc.binary_join(own, pa.scalar(b"", _BYTES)))
    return pieces


def blocks_of(text: bytes, at_once: int) -> Iterator[bytes]:
    """A text in blocks of about ``at_once`` bytes that end where a unit ends; a longer unit is one block."""
    begin = 0
    while len(text) - begin > at_once:
        found = _WORD_ENDS.search(text, begin + at_once - 1)
        if not found:
            break
        yield text[begin : found.start() + 1]
        begin = found.start() + 1
    yield text[begin:]


def _cut_long(text: bytes, first: int, second: int, at_once: int) -> list[pa.Array]:
    """``cut_units`` of one text, block by block."""
    before, found = 0, ([], [], [])
    for block in blocks_of(text, at_once):
        one = pa.array([block], _BYTES)
        for pieces, piece in zip(found, cut_units(one, pa.array([first - before]), pa.array([second - before])), strict=True):
            pieces.append(piece[0].as_py())
        before += pc.count_substring_regex(one, pattern=_UNIT)[0].as_py()
    return [pa.array([b"".join(pieces)], _BYTES) for pieces in found]


def _joined(*pieces: bytes | pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, _BYTES) if isinstance(p, bytes) else p for p in pieces], pa.scalar(b"", _BYTES))


def _remainder(x: pa.Array, by: pa.Array | pa.Scalar) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _spans(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``at_once`` bytes together, or of one row."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > at_once:
            yield begin, i
            begin, held = i, 0
        held += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def transform(texts: pa.Array, hashes: list[pa.Array], *, sentinels: tuple[bytes, bytes, bytes], rate: int, suffix_first: int, at_once: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts (large_binary) with four hashes each."""
    p, s, m = sentinels
    n = pc.count_substring_regex(texts, pattern=_UNIT).cast(pa.int64())
    taken = pc.match_substring_regex(texts, pattern=b"|".join(map(re.escape, sentinels)))
    plain = pc.or_(pc.or_(pc.equal(n, 0), taken), pc.greater_equal(_remainder(hashes[2], pa.scalar(100)), rate))
    changed = pc.invert(plain)
    places = pc.add(n, 1)
    one, other = (pc.filter(_remainder(h, places), changed) for h in hashes[:2])
    first, second, own = pc.min_element_wise(one, other), pc.max_element_wise(one, other), pc.filter(texts, changed)
    if len(own) == 1:
        prefix, middle, suffix = _cut_long(own[0].as_py(), first[0].as_py(), second[0].as_py(), at_once)
    else:
        prefix, middle, suffix = cut_units(own, first, second)
    spm = pc.less(_remainder(pc.filter(hashes[3], changed), pa.scalar(100)), suffix_first)
    output = pc.if_else(spm, _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle))
    # Each column is built for the changed rows and then dealt to the rows of the batch; plain ones take no index.
    at = pc.if_else(changed, pc.subtract(pc.cumulative_sum(changed.cast(pa.int64())), 1), pa.scalar(None, pa.int64()))
    chars = [pc.take(pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()), at) for x in (prefix, middle)]
    form = pc.coalesce(pc.take(pc.if_else(spm, "spm", "psm"), at), pa.scalar("plain"))
    return [n, form, *chars, pc.coalesce(pc.take(output, at), texts).cast(pa.large_string()).cast(pa.string())]


def fill_in_middle(
    docs: DataFrame, *, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), at_once: int = AT_ONCE
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per input row.

    ``sentinels`` stand before prefix, suffix and middle.  The first four groups of eight hexadecimal digits of the SHA-256
    of ``seed:doc_id`` choose the two cuts, whether the document is changed, and its form.
    """
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).cast(_BYTES)
            for begin, end in _spans(pc.binary_length(texts).to_numpy(zero_copy_only=False), at_once):
                rows = batch.slice(begin, end - begin)
                columns = transform(texts.slice(begin, end - begin), rows.columns[2:], sentinels=marks, rate=rate, suffix_first=suffix_first, at_once=at_once)
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *hashes).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "|".join(re.escape(s) for s in sentinels))
    one, two, middle = F.get(part, F.lit(1)), F.get(part, F.lit(2)), F.get(part, F.lit(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents),
hashed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS a, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
done AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM pieces)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM done
"""

QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {"op13_fill_middle": OP13_SQL}
