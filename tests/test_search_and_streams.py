"""Chunking against plain Python, keyword places, hybrid search, streams that stop and go on."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidscope.functions import chunking
from bidscope.operators import cases, retrieval
from bidscope.streaming import alerts

WS = " \t\n\x0b\f\r"


def plain_chunks(text, mode, size, overlap):
    count = lambda t: max(1, len(t) // (5 if re.search("[Ѐ-ӿ]", t) else 4)) if t else 0
    strip = lambda parts: [p.strip(WS) for p in parts if p.strip(WS)]
    sentences = lambda t: strip(re.split(rf"[.!?]+[{WS}]+", t))
    paragraphs = strip(re.split(rf"\n[{WS}]*\n+", text or ""))

    def packed(units, by):
        out, now, held = [], [], 0
        for u in units:
            if now and held + count(u) > size:
                out.append(by.join(now))
                now, held = [], 0
            now.append(u)
            held += count(u)
        return out + ([by.join(now)] if now else [])

    if mode == "sentence":
        found = packed(sentences(text or ""), " ")
    elif mode == "paragraph":
        found = paragraphs
    elif mode == "fixed":
        words = [w for w in re.split(rf"[{WS}]+", text or "") if w]
        found = [" ".join(words[i : i + 4 * size]) for i in range(0, len(words), 4 * size)]
    else:
        found, small = [], []
        for p in paragraphs:
            if count(p) <= size:
                small.append(p)
                continue
            found += packed(small, "\n\n") + packed(sentences(p), " ")
            small = []
        found += packed(small, "\n\n")
    out, at = [], 0
    for i, t in enumerate(found):
        shown = " ".join([w for w in re.split(rf"[{WS}]+", found[i - 1]) if w][-overlap:]) + " " + t if mode == "semantic" and i else t
        out.append((i, at, at + len(t), count(shown), shown))
        at += len(t)
    return out


@pytest.mark.parametrize("mode", ["sentence", "paragraph", "fixed", "semantic"])
def test_chunks_against_plain_python(spark, mode):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij" if rng.random() < 0.95 else "абвгд") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?!", "..."])
    paragraph = lambda n: " ".join(sentence() for _ in range(n))
    texts = [None, "", " \n \n ", "...", "one", "a.\n\nb!  c", "x" * 500 + ". y", "no end. " * 3] + [rng.choice(["\n\n", "\n \n\n"]).join(paragraph(rng.choice([1, 1, 2, 9])) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, chunk string")
    got = Counter((r.doc_id, r.chunk, r.start_char, r.end_char, r.tokens, r.text) for r in chunking.chunks(docs, mode, size=30, overlap=5).collect())
    assert got == Counter((i, *c) for i, t in enumerate(texts) for c in plain_chunks(t, mode, 30, 5))


def test_chunks_of_a_long_text(spark):
    text = "\n\n".join(f"Paragraph {i} says some words. It ends here." for i in range(40_000))
    assert len(text) > 1_500_000
    got = sorted(chunking.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect(), key=lambda r: r.chunk)
    want = plain_chunks(text, "semantic", chunking.SIZE, chunking.OVERLAP)
    assert [(r.chunk, r.start_char, r.end_char, r.tokens, r.text) for r in got] == want
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "other")


def test_keyword_places_against_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbBcé ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "ab"]
    words = ["a", "B", "ab", "abc", "CAB", "é a", "bbbb", "aaaaaa", "zzz", "", " "]
    got = cases.keyword_places(spark.createDataFrame([(t,) for t in texts], "value string"), spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    assert Counter(map(tuple, got)) == Counter((t, w) for t in {t for t in texts if t is not None} for w in words if w and w.lower() in t.lower())


def test_evidence_in_order_and_by_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b", "2020-01-05"), ("b", "c", "2020-01-02"), ("a", "c", "2020-02-01"), ("c", "d", "2020-01-01"), ("d", "e", "2020-01-01")], "src string, dst string, since string").withColumn("since", F.to_date("since"))
    got = {(r.entity, r.hop, r.via) for r in cases.linked_entities(spark.createDataFrame([("k", "a")], "case_id string, entity string"), edges).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")}


def test_hybrid_search_without_vectors_or_users(spark):
    docs = spark.createDataFrame([(0, "s", "s en", "rare words here and rare things"), (1, "s", "s en", "rare words elsewhere"), (2, "t", "t de", "nothing shared at all"), (3, "t", "t de", None)], "doc_id long, category string, title string, text string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    asks = spark.createDataFrame([(0, None), (3, 7)], "doc_id long, user_id long")
    got = retrieval.hybrid_search(docs, vectors, asks).collect()
    assert [(r.query_id, r.doc_id, r.similarity, r.score, r.place) for r in got] == [(0, 1, 1.0, 1.0, 1)]
    likes = spark.createDataFrame([(7, ["t", "s"], ["de"], ["rare"])], "user_id long, top_categories array<string>, preferred_entities array<string>, top_keywords array<string>")
    row = spark.createDataFrame([("s", "Rare thing", "s en")], "category string, text string, title string").crossJoin(likes)
    assert row.select(retrieval.personal_score(F.col("category"), F.col("text"), F.col("title"))).first()[0] == pytest.approx(0.4 * 0.5 + 0.3)


PREFERENCES = "user_id long, keywords array<string>, excluded array<string>, cpv_codes array<string>, entities array<string>, min_budget double, max_budget double"
TENDERS = "tender_id string, title string, category string, procuring_entity string, cpv_code string, estimated_value_mkd double"


def likes(spark):
    return spark.createDataFrame(
        [(1, ["road", "it"], [], [], [], None, None), (2, [], ["steel"], ["45000000"], ["ministry"], None, None), (3, [], [], [], [], 100.0, 1000.0), (4, None, None, None, None, None, 50.0), (5, [], [], [], [], None, None)], PREFERENCES
    )


def test_preference_matches(spark):
    rows = [("a", "New ROAD works", "x", "Ministry of roads", "45009999", 500.0), ("b", "with steel", "it", "The Ministry", "45001111", 5000.0), ("c", "items", "y", None, None, None), ("d", None, "IT", "City", "30", 40.0), ("e", "z", "z", "z", "z", 1000.0), ("f", "z", "z", "z", "z", 1000.5)]
    got = {tuple(r) for r in alerts.preference_matches(spark.createDataFrame(rows, TENDERS), likes(spark)).collect()}
    assert got == {(1, "a", "keyword"), (1, "b", "keyword"), (1, "d", "keyword"), (2, "a", "cpv"), (2, "a", "entity"), (3, "a", "budget"), (3, "e", "budget"), (4, "d", "budget")}


def land(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_instant_alerts_are_sent_once_over_restarts(spark, tmp_path):
    rows = [(f"T{i}", "road" if i % 2 else "other", "c", "Ministry", "45000000", float(i)) for i in range(20)]
    stream = lambda at: spark.readStream.schema(TENDERS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(at)
    once, twice = tmp_path / "once", tmp_path / "twice"
    for folder in (once, twice):
        land(spark, folder, "1", rows[:12], TENDERS)
        land(spark, folder, "2", rows[8:12] + rows[:4], TENDERS)  # arrive again
    run = lambda folder, n: alerts.instant_alerts(stream(str(folder)), likes(spark), checkpoint=str(tmp_path / f"state{n}"), out=str(tmp_path / f"out{n}"))
    assert run(twice, 2).count() > 0
    for folder in (once, twice):
        land(spark, folder, "3", rows[6:], TENDERS)
    got, want = (Counter(map(tuple, run(folder, n).collect())) for folder, n in ((twice, 2), (once, 1)))
    assert got == want and set(got.values()) == {1}
    assert {r[:2] for r in got if r[2] == "keyword"} == {(1, f"T{i}") for i in range(20) if i % 2}
    assert Counter(map(tuple, run(twice, 2).collect())) == got  # nothing new arrives


def test_evaluation_goes_on_at_its_mark(spark, tmp_path):
    schema = "tender_id string, score int, analyzed_at string"
    stream = lambda at: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(at)
    rule = lambda df: df.filter("score >= 70").select("tender_id", F.lit("high").alias("rule"), "score")
    parts = [[("a", 80, "2024-01-02"), ("b", 10, "2024-01-01")], [("a", 90, "2024-01-05"), ("c", 75, "2024-01-03")], [("d", 99, "2024-01-04"), ("b", 70, "2024-01-09")]]
    run = lambda: alerts.evaluate_arrivals(stream(str(tmp_path / "in")), rule, ["tender_id", "rule"], checkpoint=str(tmp_path / "state"), out=str(tmp_path / "out"))
    land(spark, tmp_path / "in", "1", parts[0], schema)
    first, _ = run()
    assert {tuple(r) for r in first.collect()} == {("a", "high", 80)}
    land(spark, tmp_path / "in", "2", parts[1], schema)
    land(spark, tmp_path / "in", "3", parts[2], schema)
    found, runs = run()
    assert {tuple(r) for r in found.collect()} == {("a", "high", 80), ("c", "high", 75), ("d", "high", 99), ("b", "high", 70)}
    told = sorted(runs.collect(), key=lambda r: r["batch"])
    assert [r["evaluated"] for r in told] == [2, 2, 2] and sum(r["alerts"] for r in told) == 4
    assert [r["since"] for r in told[1:]] == [r["until"] for r in told[:-1]] and str(told[-1]["until"])[:10] == "2024-01-09"
