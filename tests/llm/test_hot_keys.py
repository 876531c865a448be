"""A third of the rows under one id, without one, or equal in all; a hub host."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidscope.llm import mixing, sharding, suffix_dedup, url_filter
from bidscope.llm.common import number_rows


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("shared", [None, 7])
def test_op10_is_even_whatever_the_ids(spark, shared):
    rng = random.Random(1)
    rows = [(shared, "one hot text of some words")] * 3000 + [(1000 + i, words(rng, rng.randint(1, 12))) for i in range(3000)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load, slots = Counter(), defaultdict(list)
    for r in placed:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in placed) == Counter(i for i, _ in rows)
    assert len(load) == 24 and max(load.values()) <= 1.2 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    pieces = Counter((r.range, r.piece) for r in placed if r.doc_id == shared)
    assert max(pieces.values()) <= 300  # no window holds the hot text


def test_op6_rows_of_one_id_ask_for_their_own_anchors(spark, monkeypatch):
    rng = random.Random(2)
    passages = [words(rng, 12) for _ in range(30)]
    texts = [f"{words(rng, 10)} {rng.choice(passages)} {words(rng, 10)}" for _ in range(200)]
    asked = {}

    def anchors(ids):
        seen = {}
        inner = suffix_dedup.materialize

        def watched(df, label):
            table = inner(df, label)
            if label == "anchors":
                seen["most"], seen["all"] = table.agg(F.max(F.size("hashes")), F.sum(F.size("hashes"))).first()
            return table

        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "materialize", watched)
            docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
            got = suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs)).collect()
        return seen, got

    for kind, ids in {"own": list(range(200)), "shared": [7] * 100 + list(range(1000, 1100)), "none": [None] * 100 + list(range(100))}.items():
        asked[kind], got = anchors(ids)
        numbers = [1 << 62 if i is None else i for i in ids]
        starts = defaultdict(lambda: 1 << 63)
        for i, t in zip(numbers, texts, strict=True):
            for p in range(len(t) - 49):
                starts[t[p : p + 50]] = min(starts[t[p : p + 50]], i)
        want = Counter()
        for i, own, t in zip(ids, numbers, texts, strict=True):
            gone = {q for p in range(len(t) - 49) if starts[t[p : p + 50]] < own for q in range(p, p + 50)}
            want[(i, len(t), len(gone))] += 1
        assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == want
    assert asked["shared"]["most"] <= asked["own"]["most"] and asked["shared"]["all"] <= asked["own"]["all"]


def test_op6_equal_rows_of_one_id(spark):
    rng = random.Random(3)
    text = words(rng, 20)
    docs = spark.createDataFrame([(5, text)] * 50 + [(None, text)] * 50 + [(2, text[:60])], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_runs(docs)).collect())
    assert got == Counter({(5, len(text), 60): 50, (None, len(text), len(text)): 50, (2, 60, 0): 1})


def test_op7_shared_and_equal_rows(spark):
    rng = random.Random(4)
    rows = [(7, words(rng, rng.randint(1, 9)), "a") for _ in range(400)] + [(None, "three equal words", "b")] * 400 + [(i, words(rng, 5), "c") for i in range(400)] + [(9, "x y", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, rows_each=10).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    targets = {r.source: r.target for r in got}
    for source in targets:
        own = [r for r in got if r.source == source]
        assert all(0 <= r.taken <= 2 * r.size for r in own) and abs(sum(r.taken for r in own) - targets[source]) <= 0.5
    assert len({r.taken for r in got if r.source == "b"}) > 1  # the cut falls among equal rows
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, most_sources=3)


def test_numbers_of_a_hot_key(spark):
    df = spark.createDataFrame([(None, 0)] * 500 + [(1, 0)] * 3 + [(2, 1)], "k long, v int").withColumn("number", F.monotonically_increasing_id())
    got = defaultdict(list)
    for r in number_rows(df, ["k", "v"], "number", "place", rows_each=20).collect():
        got[r.k].append(r.place)
    assert {k: sorted(v) for k, v in got.items()} == {None: list(range(1, 501)), 1: [1, 2, 3], 2: [1]}


def test_op5_hub_host(spark):
    """A hub that a third of all links leave and enter: scores equal plain power iteration."""
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(60)]
    links = {("hub", h) for h in hosts} | {(h, "hub") for h in hosts} | {(rng.choice(hosts), rng.choice(hosts)) for _ in range(120)}
    links = {(a, b) for a, b in links if a != b}
    pages = [(n, f"http://{a}/", "<a href='http://" + "/'></a><a href='http://".join(sorted(b for x, b in links if x == a)) + "/'></a>") for n, a in enumerate(["hub", *hosts])]
    edges = url_filter.host_edges(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", url_filter.url_host(F.col("url"))))
    out = Counter(a for a, _ in links)
    seeds = {h: 1.0 / (1 + i) for i, h in enumerate(hosts)} | {"hub": 0.0}
    got = {r.host: r.score for r in url_filter.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), edges).collect()}
    score = {h: (1 - url_filter.DAMPING) * s for h, s in seeds.items()}
    for _ in range(300):
        score = {h: (1 - url_filter.DAMPING) * seeds[h] + url_filter.DAMPING * sum(score[a] / out[a] for a, b in links if b == h) for h in seeds}
    assert got.keys() == score.keys() and all(abs(got[h] - score[h]) < 1e-5 for h in score)
