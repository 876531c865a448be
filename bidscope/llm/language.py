"""Language identification of mixed-language text.

Words (runs of letters and the marks on them) are scored under each language by hashed letter trigrams and bigrams; the
scripts of a word's letters narrow it to the languages that leave the fewest of them out; the best labelling of the whole
text, by Viterbi with a penalty for each switch of language, gives spans, and the language of most letters is the
document's.  A run of more than ``MOST_LETTERS`` letters, as in scripts without spaces, is read as several words.

The model is a table of ``buckets`` counts per language, summed over every training document.  Its size is bounded
whatever the number of languages: where ``MODEL_CELLS`` don't hold 65536 buckets for each, all have fewer.

Defined results: a null text, or one without letters (Unicode category L; marks alone are none), is ``und`` with score 0;
with no training rows at all, so is every text; ties go to the language first in code-point order; a null language is
never trained on; more than ``MOST_LANGUAGES`` languages raise ValueError; a text of any length is read whole, in pieces
parted at white space where there is some; repeated rows get equal results; an empty table gives no
rows; other input columns are ignored, and kept by ``drop_undetermined``.

``score`` is the share of the letters that the winning language's spans hold.  ``evidence`` is the mean over the letters of
the log likelihood of the labelling less that of a model that knows nothing (all buckets alike): letters in no learned
language's order, or of a script that none has, get less than zero, however many languages there are.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm.common import mix64
from bidscope.workspace import release_shuffles

BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
MODEL_CELLS = 1 << 22
MOST_LANGUAGES = MODEL_CELLS >> 8
MOST_LETTERS = 16
#: A script belongs to a language that writes at least this share of its training letters in it.
LEAST_SCRIPT_SHARE = 0.005
UNDETERMINED = "und"

# The first code points of Unicode ranges, and the script from there on.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_STARTS))
_PIECE = 1 << 19
#: Letters times languages that are scored in one array operation.
_AT_ONCE = 1 << 22


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # languages x buckets: log probabilities
    scripts: np.ndarray  # languages x scripts: may a word of this script be in this language


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 no letter, 1 a letter, 2 a mark that goes on a letter; and its script's number."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))[0]
        kind[c] = 1 if category == "L" else 2 if category == "M" else 0
    starts = np.array([s for s, _ in SCRIPT_STARTS])
    number = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS], np.uint8)
    return kind, number[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _inside(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which code points belong to words: letters, and marks in a run that has a letter."""
    of = kind[points]
    inner = of > 0
    if (of == 2).any():
        at = np.flatnonzero(inner)
        cut = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        has = np.logical_or.reduceat(of[at] == 1, cut)
        inner[at[~np.repeat(has, np.diff(np.r_[cut, len(at)]))]] = False
    return inner


def _features(points: np.ndarray, kind: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of letters, their trigram and bigram buckets as two rows); what is no letter reads as a gap."""
    inner = _inside(points, kind)
    c = np.where(inner, points, 0).astype(np.uint64)
    at = np.flatnonzero(inner)
    before = np.where(at > 0, c[at - 1], 0)
    after = np.where(at + 1 < len(c), c[np.minimum(at + 1, len(c) - 1)], 0)
    bi = before << np.uint64(21) | c[at]
    tri = bi << np.uint64(21) | after
    mask = np.uint64(buckets - 1)
    return at, np.stack([mix64(tri) & mask, mix64(bi + np.uint64(1 << 50)) & mask]).astype(np.int64)


def _pieces(text: str, languages: int = 1) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a lower-cased text, parted at white space where there is some."""
    start, most = 0, min(_PIECE, max(1024, _AT_ONCE // max(1, languages)))
    while start < len(text):
        end = start + most
        if end < len(text):
            gap = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
            end = gap if gap > start else end
        yield start, text[start:end]
        start = end


def _lower(text: str) -> str:
    """Lower case, place by place, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def train(labelled: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING, cells: int = MODEL_CELLS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on all rows of ``labelled`` (text, lang).  Each task sums its counts before any row is shuffled."""
    known = labelled.filter("text is not null and lang is not null").select("text", "lang")
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    number = {x: i for i, x in enumerate(languages)}
    while len(languages) * buckets > cells and buckets > 256:
        buckets //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, script = _tables()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(buckets + len(SCRIPTS), np.int64))
                for _, piece in _pieces(_lower(text)):
                    points = _points(piece)
                    at, features = _features(points, kind, buckets)
                    if len(at) * 8 > buckets:
                        own[:buckets] += np.bincount(features.ravel(), minlength=buckets)
                    else:
                        np.add.at(own, features.ravel(), 1)
                    letters = points[at]
                    own[buckets:] += np.bincount(script[letters[kind[letters] == 1]], minlength=len(SCRIPTS))
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number[lang], np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])

    table = known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``cells`` rows and one for each script
    counts = np.zeros((len(languages), buckets + len(SCRIPTS)))
    counts[table.column("lang").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    grams, letters = counts[:, :buckets], counts[:, buckets:]
    scores = np.log((grams + smoothing) / (grams.sum(1, keepdims=True) + smoothing * buckets)).astype(np.float32)
    return Model(languages, scores, letters >= LEAST_SCRIPT_SHARE * np.maximum(1, letters.sum(1, keepdims=True)))


def _piece_scores(points: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, letters, words x languages scores) of each word among some code points."""
    kind, script = _tables()
    n_lang, buckets = model.scores.shape
    at, features = _features(points, kind, buckets)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n_lang), np.float32)
    cut = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[cut, len(at)])
    if size.max() > MOST_LETTERS:
        within = np.arange(len(at)) - np.repeat(cut, size)
        cut = np.flatnonzero(within % MOST_LETTERS == 0)
        size = np.diff(np.r_[cut, len(at)])
    each = model.scores[:, features[0]] + model.scores[:, features[1]]
    total = np.add.reduceat(each, cut, axis=1).T
    # Only the languages whose scripts leave the fewest letters of a word out stand for it.
    letter = kind[points[at]] == 1
    own = script[points[at]]
    if (own[letter] == own[letter][0]).all():
        outside = (~model.scripts[:, own[letter][:1]]).T
    else:
        outside = np.add.reduceat(~model.scripts[:, own] & letter, cut, axis=1, dtype=np.int64).T
    may = outside == outside.min(1, keepdims=True)
    return at[cut], size, np.where(may, total, total.min(1, keepdims=True) - 50.0).astype(np.float32)


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, letters, words x languages scores) of each word of a text."""
    parts = [(offset, _piece_scores(_points(piece), model)) for offset, piece in _pieces(_lower(text), len(model.languages))]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.languages)), np.float32)
    return np.concatenate([p[0] + offset for offset, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


class Labelled(NamedTuple):
    first: np.ndarray  # places of the words
    size: np.ndarray  # their letters
    label: np.ndarray  # their languages' numbers
    likelihood: float  # sum of the words' scores under their labels


def label_long(text: str, model: Model, penalty: float) -> Labelled:
    """As ``word_scores`` and ``best_labels`` give, a piece at a time: of a word only a bit for each language is kept."""
    firsts, sizes, bests, bits = [], [], [], []
    dp = np.zeros(len(model.languages))
    for offset, piece in _pieces(_lower(text), len(model.languages)):
        first, size, scores = _piece_scores(_points(piece), model)
        best = np.empty(len(first), np.int16)
        switch = np.empty(scores.shape, bool)
        for t in range(len(first)):
            best[t] = b = dp.argmax()
            jump = dp[b] - penalty
            switch[t] = dp < jump
            dp = np.maximum(dp, jump) + scores[t]
        firsts.append(first + offset)
        sizes.append(size)
        bests.append(best)
        bits.append(np.packbits(switch, axis=1))
    best = np.concatenate(bests) if bests else np.zeros(0, np.int16)
    label = np.empty(len(best), np.int64)
    state, t = int(dp.argmax()), len(best)
    for packed in reversed(bits):
        for row in packed[::-1]:
            t -= 1
            label[t] = state
            if row[state >> 3] >> (7 - (state & 7)) & 1:
                state = int(best[t])
    switches = int((label[1:] != label[:-1]).sum())
    return Labelled(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64), label, float(dp.max()) + penalty * switches if len(label) else 0.0)


def best_labels(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """The best language of each word of several texts under a switching penalty, all texts advancing word by word together."""
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    if not len(lengths) or not lengths[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    flat = np.concatenate([scores[i] for i in order])
    n_lang = flat.shape[1]
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t, for each t
    back = np.empty(flat.shape, np.int16)
    own = np.arange(n_lang, dtype=np.int16)[None, :]
    dp = np.zeros((len(lengths), n_lang))
    for t, m in enumerate(active.tolist()):
        now, rows = dp[:m], starts[:m] + t
        best = now.argmax(1)
        jump = now[np.arange(m), best][:, None] - penalty
        switch = now < jump
        back[rows] = np.where(switch, best[:, None].astype(np.int16), own)
        np.maximum(now, jump, out=now)
        now += flat[rows]
    labels = np.empty(len(flat), np.int64)
    state = dp.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = starts[:m] + t
        labels[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for i, k in enumerate(order.tolist()):
        out[k] = labels[starts[i] : starts[i] + lengths[i]]
    return out


def spans_of(first: np.ndarray, size: np.ndarray, label: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words of one language: (start, end, lang), places in code points."""
    if not len(first):
        return []
    cut = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    last = np.r_[cut[1:], len(label)] - 1
    return [{"start": int(first[a]), "end": int(first[b] + size[b]), "lang": languages[label[a]]} for a, b in zip(cut, last, strict=True)]


def label_texts(texts: list[str], model: Model, *, penalty: float, words_each: int) -> Iterator[Labelled]:
    """Each text labelled, many short ones together."""
    waiting: list[tuple] = []
    held = 0

    def flush() -> Iterator[Labelled]:
        for (first, size, scores), label in zip(waiting, best_labels([w[2] for w in waiting], penalty), strict=True):
            yield Labelled(first, size, label, float(scores[np.arange(len(label)), label].sum(dtype=np.float64)))

    for text in texts:
        if len(text) * len(model.languages) > _AT_ONCE:
            yield from flush()
            waiting, held = [], 0
            yield label_long(text, model, penalty)
            continue
        waiting.append(word_scores(text, model))
        held += len(waiting[-1][0]) * len(model.languages)
        if held > words_each:
            yield from flush()
            waiting, held = [], 0
    yield from flush()


def judged(found: Labelled, model: Model) -> tuple[str, float, float]:
    """(language, score, evidence) of a text."""
    if not len(found.label) or not model.languages:
        return UNDETERMINED, 0.0, 0.0
    share = np.bincount(found.label, weights=found.size, minlength=len(model.languages))
    best, letters = int(share.argmax()), float(share.sum())
    return model.languages[best], float(share[best] / letters), found.likelihood / letters + 2 * math.log(model.scores.shape[1])


_NOTHING = Labelled(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)


def predict(docs: DataFrame, model: Model, *, penalty: float = SWITCH_PENALTY, with_spans: bool = False, words_each: int = 1 << 21) -> DataFrame:
    """(doc_id, lang_pred, score, evidence, n_spans[, spans]), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, evidence double, n_spans int" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    types = [pa.string(), pa.float64(), pa.float64(), pa.int32()] + [span] * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = label_texts(texts, own, penalty=penalty, words_each=words_each) if own.languages else (_NOTHING for _ in texts)
            rows = []
            for each in found:
                n_spans = 1 + int((each.label[1:] != each.label[:-1]).sum()) if len(each.label) else 0
                rows.append((*judged(each, own), n_spans, *([spans_of(each.first, each.size, each.label, own.languages)] * with_spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            names = ["doc_id", "lang_pred", "score", "evidence", "n_spans", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names[: 1 + len(types)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def held_out(df: DataFrame) -> DataFrame:
    """Add ``held_out``: the rows that nothing is learned from."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    return df.withColumn("held_out", remainder == 0)


def identify(docs: DataFrame, *, with_spans: bool = False) -> DataFrame:
    """Learn from the documents that are not held out and label all of them."""
    release_shuffles(docs.sparkSession)
    marked = held_out(docs.select("doc_id", "text", "lang"))
    model = train(marked.filter("not held_out"))
    return held_out(predict(docs, model, with_spans=with_spans))


def drop_undetermined(docs: DataFrame, *, least_evidence: float = 0.0, penalty: float = SWITCH_PENALTY, words_each: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` in a language, with all their columns: those without letters go, and those whose evidence for
    all learned languages together is below ``least_evidence``.  Texts that mix learned languages stay.  Each row is
    judged where it is read, so rows that share an id, or have none, are told apart."""
    release_shuffles(docs.sparkSession)
    model = train(held_out(docs.select("doc_id", "text", "lang")).filter("not held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches if own.languages else ():
            texts = [t or "" for t in batch.column(at).to_pylist()]
            told = [judged(f, own) for f in label_texts(texts, own, penalty=penalty, words_each=words_each)]
            yield batch.filter(pa.array([lang != UNDETERMINED and evidence >= least_evidence for lang, _, evidence in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score", "evidence", "n_spans")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
