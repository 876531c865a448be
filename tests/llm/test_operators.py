"""Operators held against plain Python on a table of odd rows, and on an empty one."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bidscope.llm import exact_dedup, fingerprints, language, mixing, packing, queries, sharding, simhash, suffix_dedup

BIG = 1 << 63
ORDER = lambda i: BIG if i is None else i  # noqa: E731  a null id is the largest
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def asc_lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in ("op1_warc", "op5_url_filter", "op12_vector_codes")))
def test_every_row_is_in_the_result(spark, odd, rows, name):
    ids = [r["doc_id"] for r in queries.QUERIES[name](spark, odd).select("doc_id").collect()]
    assert (set(ids) if name == "op8_packing" else Counter(ids)) == (set(r[0] for r in rows) if name == "op8_packing" else Counter(r[0] for r in rows))


def test_op2_edited_text_and_likeness(spark, odd, rows):
    got = queries.QUERIES["op2_fingerprints"](spark, odd).collect()
    chain = sorted(((ORDER(i) if i is not None else -1, t or "") for i, t, _, _ in rows), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for k, (i, t) in enumerate(chain):
        nxt = chain[(k + 1) % len(chain)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want[(None if i == -1 else i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    text_of = defaultdict(list)
    for i, t, _, _ in rows:
        text_of[i].append(t or "")
    for r in got:
        if len(set(text_of[r.doc_id])) == 1:
            assert by_text.setdefault(text_of[r.doc_id][0], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_sketches_estimate_and_merge(spark):
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(1000, 3000))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a)], "k int, t string")
    sk = fingerprints.with_sketch(df, "t", "s")
    x, y = (r["s"] for r in sk.filter("k = 1").collect())
    pair = spark.createDataFrame([(x, y)], "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    got = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_count(F.col("a")).alias("n"), fingerprints.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(got.r - 1 / 3) < 0.15 and abs(got.c - 0.5) < 0.2 and abs(got.n - 1996) < 600
    merged = {r["k"]: r["s"] for r in fingerprints.merge_by(sk, ["k"], "s").collect()}
    assert merged[1] == got.m and merged[2] == x


def test_op3_undetermined_and_learned(spark, odd, rows):
    got = queries.QUERIES["op3_language"](spark, odd).collect()
    learned = {lang for i, _, lang, _ in rows if lang and zlib.crc32(str("" if i is None else i).encode()) % 5}
    without = Counter(i for i, t, _, _ in rows if not any(c.isalpha() for c in t or ""))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == without
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in learned | {"und"} and 0 <= r.score <= 1


def test_language_accuracy_spans_and_viterbi(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pred = {r.doc_id: r for r in language.identify(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in pred.items() if r.held_out]
    assert len(held) > 20 and sum(pred[i].lang_pred == true[i] for i in held) / len(held) >= 0.95
    rng = np.random.default_rng(3)
    many = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (0, 1, 7, 40, 7)]

    def plain(s, penalty):
        if not len(s):
            return 0.0
        dp = s[0].astype(float)
        for x in s[1:]:
            dp = np.maximum(dp, dp.max() - penalty) + x
        return dp.max()

    for s, label in zip(many, language.best_labels(many, 2.5), strict=True):
        value = sum(s[i, k] for i, k in enumerate(label)) - 2.5 * int((label[1:] != label[:-1]).sum())
        assert abs(value - plain(s, 2.5)) < 1e-3
    model = language.train(docs)
    english = next(r.text for r in docs.filter("lang = 'en' and n_chars between 800 and 2000").orderBy("doc_id").collect())
    german = next(r.text for r in docs.filter("lang = 'de' and n_chars between 800 and 2000").orderBy("doc_id").collect())
    mixed = spark.createDataFrame([(1, f"{english} {german}")], "doc_id long, text string")
    spans = language.predict(mixed, model, with_spans=True).first().spans
    assert {s.lang for s in spans} >= {"en", "de"} and spans[0].lang == "en" and spans[-1].lang == "de"


def test_op4_groups(spark, odd, rows):
    got = queries.QUERIES["op4_exact_dedup"](spark, odd).collect()
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[asc_lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=ORDER):
            kept = i == keep and left == 1
            left -= kept
            want[(i, keep, len(ids), kept, hashlib.sha256(t).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_chunks_rejoin_and_collisions_are_told_apart(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000, 200_000):
        data = rng.integers(97, 110, n, np.uint8).tobytes()
        assert b"".join(exact_dedup.chunks_of(data)) == data
        assert b"".join(exact_dedup.chunks_of(data, piece=20_000)) == data
        assert all(len(c) <= exact_dedup.MOST_CHUNK for c in exact_dedup.chunks_of(data))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["first", "other"]})
    import bidscope.llm.exact_dedup as e

    class Same:
        @staticmethod
        def xxh3_64_intdigest(_):
            return 5

    monkeypatch.setattr(e, "xxhash", Same)
    plain = next(e._recipes(iter([batch]))).column("recipe").to_pylist()
    apart = next(e._recipes(iter([batch]), frozenset([5]))).column("recipe").to_pylist()
    assert plain[0] == plain[1] and apart[0] != apart[1]


def brute_repeats(rows, width=50):
    seen, out = set(), Counter()
    by_id = defaultdict(list)
    for i, t, _, _ in rows:
        by_id[ORDER(i)].append((t or "").encode())
    for i in sorted(by_id):
        new = set()
        for t in by_id[i]:
            covered = np.zeros(len(t), bool)
            for k in range(len(t) - width + 1):
                s = t[k : k + width]
                new.add(s)
                if s in seen:
                    covered[k : k + width] = True
            kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
            spans = int((np.diff(np.r_[0, covered.astype(int), 0]) == 1).sum())
            out[(None if i == BIG else i, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
        seen |= new
    return out


def test_op6_against_brute_force(spark, odd, rows):
    got = queries.QUERIES["op6_suffix_dedup"](spark, odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_op6_over_many_small_blocks(spark, odd, rows, monkeypatch):
    docs = spark.read.parquet(f"{odd}/documents.parquet").repartition(5)
    got = suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs, bucket_bytes=1 << 12, block_bytes=1 << 11)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_op6_splits_hot_anchors_exactly(spark, odd, rows, most):
    docs = spark.read.parquet(f"{odd}/documents.parquet").repartition(5)
    got = suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs, bucket_bytes=1 << 12, block_bytes=1 << 11, most_fragments=most)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_op6_no_bucket_holds_a_hot_anchor():
    """A passage in many documents, a different word before and after it in each: its edge anchors have a fragment a document."""
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    passage = noise(120)
    texts = [noise(60) + passage + noise(60) for _ in range(400)]
    own = [np.unique(suffix_dedup.anchors(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]).astype(np.int64) for t in texts]
    anchor, n = np.unique(np.concatenate(own), return_counts=True)
    shared = anchor[n > 1]
    columns = [pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int64()), pa.array([np.intersect1d(x, shared) for x in own], pa.list_(pa.int64())), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "hashes", "text"])

    def fullest(hot):
        held = Counter()
        for out in suffix_dedup._fragment_rows(iter([batch]), 48, 1 << 12, hot, 64):
            for bucket, packed in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                held[bucket] += int(suffix_dedup._unpacked(packed)[4].sum()) if bucket >= 0 else 0
        return max(held.values())

    assert fullest(anchor[n > 200]) < fullest(np.zeros(0, np.int64)) / 2


def test_op6_minus_one_is_an_id_like_others(spark):
    passage = "the passage that both of these documents hold, of more than fifty bytes"
    rows = [(-1, f"first {passage} one", "en", "a"), (3, f"second {passage} two", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    got = suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs, block_bytes=1)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_suffix_sort_orders_and_survives_false_hashes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000, np.uint8)
    data[1000:1500] = data[200:700]
    places = np.arange(len(data) - 50)
    s = suffix_dedup.Suffixes(data)
    want = sorted(data[p : p + 50].tobytes() for p in places)
    assert [data[p : p + 50].tobytes() for p in s.sorted(places)] == want
    ordered, label = s.classes(places)
    texts = [data[p : p + 50].tobytes() for p in ordered]
    assert all((texts[i] == texts[i + 1]) == (label[i] == label[i + 1]) for i in range(len(texts) - 1))
    s.prefix[:] = 0  # every stretch claims to equal every other
    s.deep[:] = 0
    ordered, label = s.classes(places)
    texts = [data[p : p + 50].tobytes() for p in ordered]
    assert texts == want and len(set(label)) == len(set(texts))


def test_op7_targets_and_takes(spark, odd, rows):
    got = queries.QUERIES["op7_mixing"](spark, odd).collect()
    size = lambda t: len(WORD.findall(t or ""))
    per = Counter()
    for _, t, _, s in rows:
        per[s] += size(t)
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + ([None] if None in per else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2.0 * per[s] for s in per}
    total, open_, target = 1.5 * sum(per.values()), set(per), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            break
        for s in over:
            target[s] = cap[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    source_of = {(i, size(t)): s for i, t, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[(r.doc_id, r.size)]
        assert r.source_size == per[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in per)
    again = queries.QUERIES["op7_mixing"](spark, odd).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op8_pieces(spark, odd, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    own.encode_special_tokens = True
    got = queries.QUERIES["op8_packing"](spark, odd).collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array([*(own.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            want[(i, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_encoder_agrees_with_the_library():
    enc = packing.encoder(packing.default_tokenizer())
    assert enc.ranked is not None
    for text in ("plain words here and there again", "a  double  gap", " lead", "trail ", "tab\tin it now ok", "line\nbreak in the text here", "<|endoftext|> is text to us here", "don't we'll 123,456 naïve 日本 語 x", "a b\u00a0c d e f\u2003g h"):
        assert np.frombuffer(enc(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 65, 400).tolist(), reverse=True)
    placed, used = packing.best_fit(lengths, 64)
    rooms = []
    for n, (window, offset) in zip(lengths, placed, strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert rooms[window] == min(fits)
        else:
            assert window == len(rooms)
            rooms.append(64)
        assert offset == 64 - rooms[window]
        rooms[window] -= n
    assert [64 - r for r in rooms] == used


def test_op9_against_brute_force(spark, odd, rows):
    got = queries.QUERIES["op9_simhash"](spark, odd).collect()
    fps = {}
    for i, t, _, _ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", asc_lower(t))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps.setdefault((i, t), sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    values = sorted(set(fps.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= 3:
                parent[root(b)] = root(a)
    best = {}
    for (i, _), v in fps.items():
        if i is not None:
            best[root(v)] = min(best.get(root(v), i), i)
    want = Counter((i, f"{fps[(i, t)]:016x}", best.get(root(fps[(i, t)]))) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_golay_keys_meet_within_three_bits():
    code = simhash.Golay()
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 23, 2000, np.uint32)
    again = words ^ (np.uint32(1) << rng.integers(0, 23, 2000).astype(np.uint32))
    row, index = code.ball(words, 23)
    balls = defaultdict(set)
    for r, i in zip(row.tolist(), index.tolist(), strict=True):
        balls[r].add(i)
    assert all(int(k) in balls[n] for n, k in enumerate(code.index(again)))
    assert {len(b) for b in balls.values()} <= {1, 6}
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    for errors in (0, 1, 2, 3):
        other = base.copy()
        for n in range(len(base)):
            for bit in rng.choice(64, errors, replace=False):
                other[n] ^= np.uint64(1) << np.uint64(bit)
        keys = [defaultdict(set), defaultdict(set)]
        for side, fps in enumerate((base, other)):
            for r, k in zip(*(x.tolist() for x in simhash.fingerprint_keys(fps, code)), strict=True):
                keys[side][r].add(k)
        assert all(keys[0][n] & keys[1][n] for n in range(len(base)))


def test_dense_groups_give_few_links():
    values = np.unique(np.array([(1 << a) ^ (1 << b) for a in range(64) for b in range(64)], np.uint64))
    links = simhash._forest(values)
    assert len(links) == len(values) - 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)] + [(100, 200), (100, 100)], "src long, dst long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert {got[i] for i in range(-39, 41)} == {-40} and got[200] == 100 and len(got) == 81


def test_op10_slots_and_balance(spark, odd, rows):
    got = queries.QUERIES["op10_sharding"](spark, odd).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_sharding_subdivides_a_hot_text(spark):
    hot = [(i, "the same text again and again") for i in range(3000)] + [(10_000 + i, f"text {i} of its own " * (i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(hot, "doc_id long, text string")
    placed = sharding.shard_documents(docs).groupBy("shard").agg({"size": "sum"}).collect()
    loads = [r[1] for r in placed]
    assert len(loads) == 24 and max(loads) <= 1.02 * min(loads)


def test_mixing_level_is_the_highest(spark):
    """Targets by filling: the small source stops at twice its size, and the excess lifts the others by weight."""
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    left = 1.5 * 2050 - 20 - 80
    assert got == {"a": 20.0, "b": pytest.approx(left / 3), "c": pytest.approx(2 * left / 3), None: 80.0}


# --- plain versions of the operators without SQL --------------------------------------------------------------------------


def spark_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text, k=128):
    words = [spark_hash(w) for w in WORD.findall(text)]
    hashes = set()
    for i in range(max(len(words) - 4, min(len(words), 1))):
        h = 42
        for w in words[i : i + 5]:
            h = spark_hash(w, h % (1 << 64))
        hashes.add((h % (1 << 64)) >> 16)
    return sorted(hashes)[:k]


def plain_likeness(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return len([h for h in union if h in a and h in b]) / len(union) if union else 1.0


def plain_op2(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for n, (i, t, *_) in enumerate(ordered):
        text, ahead = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + ahead[:half]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(ahead)
        hexed = lambda s: "".join(f"{h:012x}" for h in s)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return Counter(out)


def op2_rows(found):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect())


def test_op2_against_a_plain_version(spark, odd, rows):
    assert op2_rows(queries.QUERIES["op2_fingerprints"](spark, odd)) == plain_op2(rows)


def test_op2_over_many_ranges_with_crowded_ids(spark, monkeypatch):
    """An id, and null, that more rows share than ranges hold; some of their texts are equal."""
    rng = random.Random(8)
    rows = [(7, f"{rng.random()} of seven") for _ in range(60)] + [(None, f"{rng.randint(0, 9)} of none") for _ in range(60)] + [(i, f"text {i} " * (i % 5)) for i in range(-40, 60)]
    whole = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda df, carry: whole(df, carry, rows_each=8))
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert op2_rows(got) == plain_op2(rows)


def plain_language(rows, buckets=1 << 16):
    """Documents' languages letter by letter and word by word, without arrays."""
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 0

    def mix(x):
        m = (1 << 64) - 1
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        return x ^ x >> 32

    def words_of(text):
        """[(letters, [buckets])] of runs of letters and marks with a letter, 16 at a time."""
        text = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        inner, out = set(), []
        spaced = [unicodedata.category(c)[0] in "LM" for c in text]
        n = 0
        while n < len(text):
            if not spaced[n]:
                n += 1
                continue
            end = n
            while end < len(text) and spaced[end]:
                end += 1
            if any(unicodedata.category(c)[0] == "L" for c in text[n:end]):
                inner |= set(range(n, end))
                out += [(a, min(a + 16, end)) for a in range(n, end, 16)]
            n = end
        code = lambda k: ord(text[k]) if k in inner else 0
        grams = lambda k: (mix((code(k - 1) << 42 | code(k) << 21 | code(k + 1)) & ((1 << 64) - 1)) % buckets, mix((code(k - 1) << 21 | code(k)) + (1 << 50)) % buckets)
        return [[(text[k], *grams(k)) for k in range(a, b)] for a, b in out]

    script = lambda c: [s for start, s in language.SCRIPT_STARTS if start <= ord(c)][-1]
    counts, letters = {}, {}
    for i, t, lang, _ in rows:
        if held(i) or lang is None or t is None:
            continue
        own, of = counts.setdefault(lang, Counter()), letters.setdefault(lang, Counter())
        for word in words_of(t):
            for c, tri, bi in word:
                own[tri] += 1
                own[bi] += 1
                if unicodedata.category(c)[0] == "L":
                    of[script(c)] += 1
    names = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * buckets for x in names}
    score = lambda x, b: math.log((counts[x][b] + 0.5) / total[x])
    writes = {x: {s for s, n in letters[x].items() if n >= 0.005 * max(1, sum(letters[x].values()))} for x in names}
    out = []
    for i, t, _, _ in rows:
        words = words_of(t or "")
        best, back = [0.0] * len(names), []
        for word in words:
            sums = [sum(score(x, tri) + score(x, bi) for _, tri, bi in word) for x in names]
            outside = [sum(unicodedata.category(c)[0] == "L" and script(c) not in writes[x] for c, _, _ in word) for x in names]
            sums = [s if o == min(outside) else min(sums) - 50 for s, o in zip(sums, outside, strict=True)]
            top = best.index(max(best))
            back.append([top if best[k] < best[top] - 12 else k for k in range(len(names))])
            best = [max(best[k], best[top] - 12) + sums[k] for k in range(len(names))]
        share, state = Counter(), best.index(max(best))
        for word, step in zip(reversed(words), reversed(back), strict=True):
            share[state] += len(word)
            state = step[state]
        if not words:
            out.append((i, held(i), "und", 0.0))
        else:
            win = min(share, key=lambda k: (-share[k], k))
            out.append((i, held(i), names[win], round(share[win] / sum(share.values()), 6)))
    return Counter(out)


def test_op3_against_a_plain_version(spark, odd, rows):
    got = queries.QUERIES["op3_language"](spark, odd).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got) == plain_language(rows)


def test_op3_letters_marks_and_far_scripts(spark):
    rows = [(i, "plain words of one language here", "en", None) for i in range(20)] + [(100, "́̂ ́", None, None), (101, "\U000323ae\U000313f0", None, None), (102, "é ́", None, None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[100] == "und" and got[101] == got[102] == "en"
    kind, script = language._tables()
    assert language.SCRIPTS[script[0x323AF]] == "han" and kind[0x323AF] == 1 and language.SCRIPTS[script[0x323B0]] == "other"


def test_language_long_texts_and_bounded_model(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labelled = language.held_out(docs).filter("not held_out")
    model = language.train(labelled)
    texts = [r.text for r in docs.filter("text is not null").orderBy(F.length("text").desc()).limit(6).collect()]
    usual = list(language.label_texts(texts, model, penalty=12.0, words_each=1 << 21))
    monkeypatch.setattr(language, "_AT_ONCE", 4096)  # pieces of 1024 letters, each text on the long way
    for a, b in zip(usual, language.label_texts(texts, model, penalty=12.0, words_each=1 << 21), strict=True):
        assert (a.label == b.label).all() and (a.first == b.first).all() and a.likelihood == pytest.approx(b.likelihood, rel=1e-6)
    many = spark.createDataFrame([(f"words of language {i} {'abcdefgh'[i % 8] * 9}", f"l{i}") for i in range(40)], "text string, lang string")
    assert language.train(many, cells=1 << 15).scores.shape == (40, 512)
    with pytest.raises(ValueError):
        language.train(many, most_languages=39)


def test_op6_null_and_the_greatest_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(90))
    top = (1 << 63) - 1
    rows = [(None, text + "A"), (top, text + "B"), (top - 1, text + "C"), (None, text + "D")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs)).collect()}
    assert got == {(top - 1, 91, 0), (top, 91, 90), (None, 91, 90)}
    with pytest.raises(ValueError):
        suffix_dedup.repeated_runs(spark.createDataFrame([(None, "a"), (top, "b"), (-top - 1, "c")], "doc_id long, text string"))


def test_op9_full_keys_go_into_narrower_ones(spark, odd, monkeypatch):
    """Keys of more than a few fingerprints, over several rounds, give the links that brute force gives."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4) for _ in range(40)]
    fps = sorted({v - (1 << 64) if v >> 63 else v for v in near})
    keyed = spark.createDataFrame([(k % 2, v) for k, v in enumerate(fps)] + [(2, v) for v in fps], "key long, fp long")
    roots = {}
    for most in (16, 1 << 15):
        found = simhash.components(simhash.links_of(keyed, most_held=most)).collect()
        roots[most] = {r.node: r.root for r in found}
    assert roots[16] == roots[1 << 15]
    parent = {v: v for v in fps}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: r for v, r in ((v, root(v)) for v in fps) if v != r} == roots[16]


def test_op8_deals_full_groups_again(spark):
    rows = [(None, None)] * 300 + [(5, "the same words")] * 300 + [(i, f"words {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_pieces(packing.pieces_of(docs), 4, window=64, most_pieces=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64


def test_op10_keeps_equal_texts_together_and_shards_even(spark, odd, rows):
    got = queries.QUERIES["op10_sharding"](spark, odd).collect()
    total = sum(r.size for r in got)
    group, where = Counter(), defaultdict(set)
    for r in got:
        group[(r.text_crc32, r.size)] += r.size
        where[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(where[g]) == 1 for g in group if group[g] <= total / 24)
    rng = random.Random(3)
    many = [(i, "word " * rng.randint(1, 40)) for i in range(4000)] + [(9000 + i, "one hot text " * 20) for i in range(3000)] + [(20_000 + i, None) for i in range(2000)]
    placed = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string")).collect()
    load, slots = Counter(), defaultdict(list)
    for r in placed:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(load) == 24 and max(load.values()) <= 1.2 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(placed) == len(many)
    assert len({r.shard for r in placed if r.size == 8}) == 1  # many rows, few bytes: one shard, numbered in parts
