"""Licence scans, vector codes and fill-in-middle against plain Python, on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bidscope.llm import fill_middle, licences, queries, vector_codes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

TEXTS = [
    None, "", " \n\t", "MIT License", "mit--LICENSE mit license", "mit licenses", "commit license", "the GNU General\nPublic License gnu general public license.", "CC-BY 4.0 and cc_by and ccby", "éMIT License MIT Licenseé MIT License",
    "Apache License apache license, Version 2.0, MIT apache LICENSE", "gnu gnu general public license license", "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND Apache-2.0\ncode",
    "SPDX-License-Identifier: MIT OR\n", "SPDX-License-Identifier: (MIT", "SPDX License Identifier: MIT", "x spdx-license-identifier:MIT\nSPDX-License-Identifier: GPL-3.0-or-later", "mit license " * 3000, "word " * 100_000 + "mit license",
]


def plain_base(text):
    words = WORDS.findall((text or "").translate(ASCII))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def licence_rows(spark, folder, texts):
    spark.createDataFrame([(i // 2, t, "7") for i, t in enumerate(texts)], "doc_id long, text string, labels string").write.parquet(f"{folder}/documents.parquet")
    return queries.QUERIES["op11_licences"](spark, str(folder)).collect()


def test_op11_base_against_plain_words(spark, tmp_path, odd, rows):
    got = licence_rows(spark, tmp_path, TEXTS)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i // 2, *plain_base(t)) for i, t in enumerate(TEXTS))
    for r in got + queries.QUERIES["op11_licences"](spark, odd).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_op11_base_on_the_small_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op11_licences"](spark, small).collect()
    assert len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])


def test_automaton_in_pieces_equals_the_whole():
    rng = random.Random(4)
    scanner = licences.Scanner(licences.BASE, licences.NOTICES, licences.TAGS)
    parts = [w for p in [*licences.BASE, *licences.NOTICES] for w in p.split()] + ["SPDX-License-Identifier: MIT\n", "(", "é", "--"]
    for _ in range(50):
        text = " ".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice([*licences.BASE, *licences.NOTICES]) for _ in range(60)).encode()
        whole, pieces = scanner.scan(text, with_hits=True), scanner.scan(text, with_hits=True, at_once=7)
        assert whole == pieces
        for hit in whole.hits:
            if hit["label"] != "tag":
                assert licences.spaced_words(text[hit["begin"] : hit["end"]]).decode("latin-1").strip() == hit["phrase"]


@pytest.mark.parametrize(
    ("text", "valid", "use", "labels"),
    [
        (" MIT", True, "permissive", {"mit"}), (" gpl-2.0-only or MIT", True, "permissive", {"gpl-2.0-only", "mit"}), (" GPL-2.0+ AND MIT", True, "copyleft", {"gpl-2.0+", "mit"}),
        (" GPL-2.0-only WITH Classpath-exception-2.0", True, "weak copyleft", {"gpl-2.0-only", "classpath-exception-2.0"}),
        (" GPL-2.0-only OR MIT AND CC-BY-NC-4.0", True, "copyleft", {"gpl-2.0-only", "mit", "cc-by-nc-4.0"}), (" (GPL-2.0-only OR MIT) AND CC-BY-NC-4.0", True, "restricted", {"gpl-2.0-only", "mit", "cc-by-nc-4.0"}),
        (" LicenseRef-own", True, "unknown", {"licenseref-own"}), (" MIT\nAND GPL-2.0-only", True, "permissive", {"mit"}), (" MIT) and more", True, "permissive", {"mit"}), (" MIT this file", True, "permissive", {"mit"}),
        (" MIT AND", False, None, set()), (" (MIT", False, None, set()), (" MIT WITH Apache-2.0", False, None, set()), (" (MIT) WITH Classpath-exception-2.0", False, None, set()), ("", False, None, set()), (" OR MIT", False, None, set()),
        (" MIT OR (", False, None, set()), (" ()", False, None, set()), (" Classpath-exception-2.0", False, None, set()), (" MIT WITH (Classpath-exception-2.0)", False, None, set()),
    ],
)
def test_expressions(text, valid, use, labels):
    got = licences.parse(text.encode())
    assert got.valid == valid and (licences.USES[got.use] if valid else None) == use and got.labels == labels


def test_expressions_against_a_recursive_value():
    """Random nested expressions; depth and length far beyond any stack of calls."""
    rng = random.Random(8)
    ids = {"mit": 4, "lgpl-3.0": 3, "gpl-3.0": 2, "cc-by-nc-4.0": 1, "licenseref-x": 0}

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            name = rng.choice(list(ids))
            return name, ids[name]
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        op = rng.choice(["AND", "OR"])
        return f"({a}) {op} ({b})", (min if op == "AND" else max)(x, y)

    for _ in range(100):
        text, value = make(5)
        got = licences.parse(text.encode())
        assert got.valid and got.use == value
    deep = licences.parse(b"(" * 50_000 + b"MIT" + b")" * 50_000 + b" AND GPL-2.0-only" * 1000)
    assert deep.valid and licences.USES[deep.use] == "copyleft"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Brute force in Python's own integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter()
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda u, book: min((sum((a - b) ** 2 for a, b in zip(u, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def vectors(kind):
    rng = random.Random(6)
    some = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice([0, 1, None])) for i in range(120)]
    odd = [(900, None, 1), (901, [0.5] * 15 + [None], 1), (902, [0.5] * 15 + [math.nan], 1), (903, [math.inf] + [0.1] * 15, 2), (None, [0.25] * 16, None), (None, [-0.25] * 16, 3), (5, [0.5] * 16, 0), (5, [0.5] * 16, 0)]
    return {
        "odd": some + odd, "equal": [(i % 7, [0.125, -0.3] * 8, 1) for i in range(60)], "few": some[:5], "lattice": [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(16)], i % 3) for i in range(200)],
        "ragged": [(i, [rng.uniform(-2, 2) for _ in range(i % 12)], 0) for i in range(40)], "none": odd[:4], "far": [(i, [rng.uniform(-9000, 9000) for _ in range(16)], 0) for i in range(50)],
    }[kind]


@pytest.mark.parametrize("kind", ["odd", "equal", "few", "lattice", "ragged", "none", "far"])
def test_op12_against_brute_force(spark, tmp_path, kind):
    spark.createDataFrame([(*r, "x") for r in vectors(kind)], "vec_id long, embedding array<double>, label int, code string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(vectors(kind))


def test_equal_average_search_against_all_distances():
    rng = np.random.default_rng(2)
    for spread in (2, 50, 100_000):
        entries, parts = rng.integers(-spread, spread, (16, 8)), rng.integers(-spread, spread, (500, 8))
        parts[:16] = entries[::-1]
        apart = ((parts[:, None] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.nearest(parts, entries)
        assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_codes_decode_to_their_error(spark):
    df = spark.createDataFrame(vectors("odd"), "vec_id long, embedding array<double>, label int")
    ints = vector_codes.integer_vectors(df)
    books = vector_codes.train_codebooks(ints, entries=8, rounds=2)
    for r in vector_codes.decode(vector_codes.encode(ints, books, keep=("vec_id", "ints")), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.ints, r.approximation, strict=True)) == r.error


def test_huge_components_stay_in_bounds(spark, tmp_path):
    pq.write_table(pa.table({"vec_id": list(range(20)), "embedding": pa.array([[3.4e38 * (-1) ** i] * 8 for i in range(20)], pa.list_(pa.float32())), "label": [1] * 20}), tmp_path / "embeddings.parquet")
    got = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(r.error == 0 for r in got)


def plain_middle(i, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return i, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


MIDDLES = [None, "", " ", "one", " one  two\n", "a <P> b", "<<S>", "<S", "P> <", " é x \u0000 y", "日本 語", "\t\n\x0b\x0c\r", "word " * 3000, "x" * 50_000, "a b\x1cc\x85d e"]


def test_op13_against_plain_python(spark, tmp_path, odd, rows):
    planted = [(k, t) for t in MIDDLES for k in range(12)] + [(None, "no id here"), (-5, "less than none"), (3, "one"), (3, "one")]
    spark.createDataFrame([(*r, "z") for r in planted], "doc_id long, text string, n string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, given in ((str(tmp_path), planted), (odd, [r[:2] for r in rows])):
        got = queries.QUERIES["op13_fill_middle"](spark, folder).collect()
        assert Counter(map(tuple, got)) == Counter(plain_middle(i, t) for i, t in given)


@pytest.mark.parametrize("at_once", [1, 40, 5000])
def test_fill_in_middle_block_by_block(spark, odd, rows, at_once):
    docs = spark.read.parquet(f"{odd}/documents.parquet").filter("length(text) < 4000 or text is null")
    got = Counter(map(tuple, fill_middle.fill_in_middle(docs, at_once=at_once).collect()))
    assert got == Counter(map(tuple, fill_middle.fill_in_middle(docs).collect())) and len(got) > 30


def test_restored_with_other_sentinels(spark, odd):
    marks = ("[[pre|", "[[suf|", "[[mid|")
    docs = spark.read.parquet(f"{odd}/documents.parquet").filter("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    out = fill_middle.fill_in_middle(docs, rate=100, sentinels=marks)
    from pyspark.sql import functions as F

    back = out.join(docs, "doc_id").select("form", (fill_middle.restored(F.col("output"), F.col("form"), marks) == F.col("text")).alias("same")).collect()
    assert all(r.same for r in back) and {r.form for r in back} >= {"spm", "psm"}
