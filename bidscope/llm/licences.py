"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates what tags declare.

A text is lower-cased (A-Z) and its words are joined by single spaces, each phrase with a space on both sides, so that one
automaton finds all phrases at word limits, overlapping ones too.  Texts are fed to it piece by piece.  Where the words of a
tag are found, the original bytes decide whether they are one (``SPDX-License-Identifier:``), and the expression behind it
is read: identifiers, ``and``, ``or``, ``with`` and parentheses, two stacks, no recursion.  An expression ends where an
operator would have to stand and does not; one that ends in an operator or with an open parenthesis is not valid and gives
no labels.  Its value is what the licensee may do: the best of an ``or``, the worst of an ``and``, one step better by an
exception after ``with``.

Every document is scanned where it is read: no shuffle, whatever the sizes of groups.

Defined results: a null text is empty; a text without finds has empty labels, null word numbers and score 0; repeated
rows give repeated rows; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of notices, how they are labelled, and how surely they say under which licence a text is.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.8),
    "gnu general public license version 2": ("gpl-2.0", 0.8),
    "gnu general public license version 3": ("gpl-3.0", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu library general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "gnu free documentation license": ("gfdl", 0.8),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "european union public licence": ("eupl", 0.7),
    "boost software license": ("bsl", 0.7),
    "bsd license": ("bsd", 0.6),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "isc license": ("isc", 0.6),
    "zlib license": ("zlib", 0.6),
    "artistic license": ("artistic", 0.6),
    "sil open font license": ("ofl", 0.8),
    "creative commons": ("creative-commons", 0.4),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0 1 0": ("cc0-1.0", 0.6),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "released into the public domain": ("public-domain", 0.7),
    "dedicated to the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.3),
}
#: Tags whose value is an expression, as they stand in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:", "packagelicensedeclared:", "packagelicenseconcluded:", "packagelicenseinfofromfiles:")
BASE_STRENGTH, TAG_STRENGTH = 0.5, 0.95

#: What a licence asks of those who pass a work on, from most to least, by the longest start of its identifier.
USES = ("unknown", "restricted", "copyleft", "weak copyleft", "permissive")
FAMILIES = {
    "mit": 4, "apache": 4, "bsd": 4, "isc": 4, "zlib": 4, "0bsd": 4, "unlicense": 4, "cc0": 4, "cc-by": 4, "bsl": 4, "python": 4, "psf": 4, "postgresql": 4, "openssl": 4, "ofl": 4, "wtfpl": 4, "x11": 4, "ncsa": 4,
    "lgpl": 3, "mpl": 3, "epl": 3, "cddl": 3, "eupl": 3, "artistic": 3, "cpl": 3, "ms-pl": 3,
    "gpl": 2, "agpl": 2, "cc-by-sa": 2, "gfdl": 2, "osl": 2, "sspl": 2,
    "cc-by-nc": 1, "cc-by-nd": 1, "busl": 1, "elastic": 1, "none": 1, "licenseref-proprietary": 1,
}

#: Characters of text that the automaton is fed at once.
AT_ONCE = 1 << 20
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(ord(chr(b).lower()) if b in _WORD_BYTES and b < 0x80 else b if b in _WORD_BYTES else 0x20 for b in range(256))
_GAPS = re.compile(rb"  +")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?(?::[A-Za-z0-9][A-Za-z0-9.\-]*)?)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def spaced_words(text: bytes) -> bytes:
    """The lower-case words of a text with one space before, between and behind them; empty without words."""
    words = _GAPS.sub(b" ", text.translate(_FOLD)).strip(b" ")
    return b" %b " % words if words else b""


def use_of(identifier: str) -> int:
    """Place in ``USES`` by the longest family that the identifier begins with."""
    families = [f for f in FAMILIES if identifier == f or identifier.startswith((f"{f}-", f"{f}+"))]
    return FAMILIES[max(families, key=len)] if families else 0


@dataclass(frozen=True)
class Expression:
    text: str
    valid: bool
    use: int = 0
    labels: frozenset = frozenset()


def _is_exception(identifier: str) -> bool:
    return "exception" in identifier or identifier.startswith("additionref-")


def parse(data: bytes, at: int = 0) -> Expression:
    """The expression that begins at ``at``: operators wait on one stack, values ``(use, is one identifier)`` on another."""
    values: list[tuple[int, bool]] = []
    waiting: list[str] = []
    said: list[str] = []
    labels: set[str] = set()
    operand_next = True

    def apply(operator: str) -> bool:
        right, left = values.pop(), values.pop()
        if operator == "with":
            values.append((min(left[0] + 1, len(USES) - 1) if left[0] > 1 else left[0], False))
            return left[1]
        values.append(((max if operator == "or" else min)(left[0], right[0]), False))
        return True

    while found := _TOKEN.match(data, at):
        token = found[1].decode().lower()
        after_with = bool(waiting) and waiting[-1] == "with" and operand_next
        if operand_next:
            if token == "(" and not after_with:
                waiting.append(token)
            elif token == ")" or token == "(" or token in _PRECEDENCE:
                return Expression(" ".join(said), False)
            elif after_with != _is_exception(token):
                return Expression(" ".join([*said, token]), False)
            else:
                values.append((0 if after_with else use_of(token), True))
                labels.add(token)
                operand_next = False
        elif token == ")":
            if "(" not in waiting:
                break
            while (operator := waiting.pop()) != "(":
                if not apply(operator):
                    return Expression(" ".join(said), False)
            values[-1] = (values[-1][0], False)
        elif token in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                if not apply(waiting.pop()):
                    return Expression(" ".join(said), False)
            if token == "with" and not values[-1][1]:
                return Expression(" ".join(said), False)
            waiting.append(token)
            operand_next = True
        else:
            break
        said.append(token)
        at = found.end()
    while waiting and not operand_next and waiting[-1] != "(":
        if not apply(waiting.pop()):
            return Expression(" ".join(said), False)
    if operand_next or waiting:
        return Expression(" ".join(said), False)
    return Expression(" ".join(said), True, values[0][0], frozenset(labels))


@dataclass
class Scan:
    """What one text holds."""

    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set = field(default_factory=set)
    labels: set = field(default_factory=set)
    expressions: list = field(default_factory=list)
    hits: list = field(default_factory=list)
    doubt: float = 1.0

    @property
    def use(self) -> str | None:
        """All valid expressions hold at once."""
        valid = [e.use for e in self.expressions if e.valid]
        return USES[min(valid)] if valid else None


class Scanner:
    """The automaton over all phrases and tags; built once in each task from the tables."""

    def __init__(self, base: dict[str, str], notices: dict[str, tuple[str, float]], tags: tuple[str, ...]):
        tag_words = {spaced_words(t.encode()).decode("latin-1").strip(): t.encode() for t in tags}
        self.phrases = sorted({*base, *notices, *tag_words})
        self.base, self.notices, self.tags = base, notices, tag_words
        self.automaton = ahocorasick.Automaton()
        for k, phrase in enumerate(self.phrases):
            self.automaton.add_word(f" {phrase} ", k)
        self.automaton.make_automaton()

    def finds(self, words: bytes, at_once: int) -> Iterator[tuple[int, int]]:
        """(place of the space before the phrase, number of the phrase), piece by piece."""
        text = words.decode("latin-1")
        search = self.automaton.iter(text[:at_once])
        begin = 0
        while True:
            for end, k in search:
                yield end - len(self.phrases[k]) - 1, k
            begin += at_once
            if begin >= len(text):
                return
            search.set(text[begin : begin + at_once])

    def scan(self, text: bytes, *, with_hits: bool = False, at_once: int = AT_ONCE) -> Scan:
        words = spaced_words(text)
        out = Scan(n_words=max(0, words.count(b" ") - 1))
        first, last, seen, tagged = len(words), -1, set(), []
        for place, k in self.finds(words, at_once) if words else ():
            phrase = self.phrases[k]
            seen.add(phrase)
            if phrase in self.base:
                out.n_base += 1
                first, last = min(first, place), max(last, place)
            if phrase in self.tags:
                tagged.append((place, k))
            if with_hits:
                out.hits.append((place, k))
        if out.n_base:
            out.first_word, out.last_word = words.count(b" ", 0, first), words.count(b" ", 0, last)
        out.base_labels = {self.base[p] for p in seen if p in self.base}
        out.labels = out.base_labels | {self.notices[p][0] for p in seen if p in self.notices}
        if tagged or out.hits:
            self._resolve(text, words, tagged, out)
        valid = [e for e in out.expressions if e.valid]
        out.labels |= {label for e in valid for label in e.labels}
        for strength in [*[BASE_STRENGTH] * len(out.base_labels), *(self.notices[p][1] for p in sorted(seen) if p in self.notices), *[TAG_STRENGTH] * bool(valid)]:
            out.doubt *= 1 - strength
        return out

    def _resolve(self, text: bytes, words: bytes, tagged: list, out: Scan) -> None:
        """Places in the words to places in the text: expressions behind tags, and the bytes of each hit."""
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
        inside = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
        turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = turns[::2], turns[1::2]
        for place, k in tagged:
            begin, tag = int(starts[np.searchsorted(gaps, place)]), self.tags[self.phrases[k]]
            if text[begin : begin + len(tag)].lower() == tag:
                out.expressions.append(parse(text, begin + len(tag)))
        hits = []
        for place, k in out.hits:
            word, phrase = int(np.searchsorted(gaps, place)), self.phrases[k]
            label = self.base.get(phrase) or self.notices.get(phrase, ("tag",))[0]
            hits.append({"phrase": phrase, "label": label, "word": word, "begin": int(starts[word]), "end": int(ends[word + phrase.count(" ")])})
        out.hits = hits


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "expressions array<struct<text:string,valid:boolean,use:string>>, use string, hits array<struct<phrase:string,label:string,word:long,begin:long,end:long>>"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(),
    pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("use", pa.string())])), pa.string(),
    pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])),
]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "use", "hits"]


def _row(found: Scan) -> tuple:
    said = [{"text": e.text, "valid": e.valid, "use": USES[e.use] if e.valid else None} for e in found.expressions]
    return (found.n_words, found.n_base, found.first_word, found.last_word, sorted(found.base_labels), sorted(found.labels), 1 - found.doubt, said, found.use, found.hits)


def scan_licences(
    docs: DataFrame, *, base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None, tags: tuple[str, ...] = TAGS, with_hits: bool = False, at_once: int = AT_ONCE,
    rows_each: int = 1024,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, use, hits), one row per input row.

    ``hits``, with words and UTF-8 byte places (end excluded), is empty unless ``with_hits``.  ``score`` is the chance
    that at least one find is right, from 0 without finds, if each errs by itself.
    """
    tables = (BASE if base is None else base, NOTICES if notices is None else notices, tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*tables)
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_each):
                some = batch.slice(begin, rows_each)
                texts = some.column(1).cast(pa.binary())
                rows = [_row(scanner.scan(text.as_py() or b"", with_hits=with_hits, at_once=at_once)) for text in texts]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("base_labels"), listed("labels"), "score", F.size("expressions").alias("n_expressions"), "use")


QUERIES = {"op11_licences": op11_licences}
ORACLES: dict[str, str] = {}
