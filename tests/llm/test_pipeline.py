"""The pipeline's stages on odd rows: columns, decisions, and what must stay."""

import random
from collections import Counter

import corpus_pipeline
from bidscope.llm.mixing import mix_sources
from bidscope.workspace import materialize


def test_stages(spark, odd, rows):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, odd), name)
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    # One letter over and over is no language, and a text mostly of a script that nothing was learned of is in none.
    letters = lambda t: any(c.isalpha() for c in t or "") and set(t) - set("xy") and "日本語" not in t
    assert Counter(r.doc_id for r in seen["language"]) == Counter(i for i, t, _, _ in rows if letters(t))
    texts = Counter(r.text.encode().lower() for r in seen["exact_dedup"])
    assert set(texts.values()) == {1} and set(texts) == {t.encode().lower() for i, t, _, _ in rows if letters(t)}
    kept = {r.doc_id for r in seen["near_dedup"]}
    assert kept and kept <= {r.doc_id for r in seen["exact_dedup"]}
    assert {r.doc_id for r in seen["mix"]} <= kept and max(Counter(r.doc_id for r in seen["mix"]).values()) <= 2
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["mix"]}


def test_run_equals_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
    want = Counter(map(tuple, docs.collect()))
    assert want and Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == want


def test_language_stage_drops_jumble_and_foreign_text_only(spark, small):
    """Planted texts: random letters and languages that nothing was learned of go; every document and mixtures stay."""
    rng = random.Random(2)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.lang: r.text for r in docs.filter("length(text) > 200").collect()}
    jumble = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(20)]
    foreign = ["один два три четыре пять шесть семь восемь", "我们都是中国人今天天气很好", "καλημέρα κόσμε τι κάνεις", "12345 -- !!", "", None]
    mixed = [" ".join(t[:150] for t in texts.values())]
    planted = [(-1 - n, t, None, "planted", len(t or "")) for n, t in enumerate(jumble + foreign + mixed)]
    whole = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    got = Counter(r.doc_id for r in corpus_pipeline.language_stage(spark, whole, "").collect())
    letters = Counter(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert got == letters + Counter({-len(planted): 1})


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(n))


def test_near_stage_keeps_a_row_of_each_component(spark):
    """Rows without an id, and rows that share one, in components of their own; one shared id lies in a component of a smaller one."""
    loose = [(None, words(i), "en", "a") for i in range(30)]
    shared = [(7, words(100 + i), "en", "a") for i in range(5)]
    copied = [(2, words(200), "en", "b"), (5, words(200).upper(), "en", "b"), (5, words(201), "en", "b"), (None, words(200) + " ", "en", "b")]
    got = corpus_pipeline.near_stage(spark, table(spark, loose + shared + copied), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _, _ in loose + shared + [copied[0], copied[2]])


def test_mix_stage_takes_rows_one_by_one(spark):
    """A source without ids, one whose rows share an id, and repeated rows: as many words as the mix takes, row by row."""
    rows = [(None, words(i, 20), "en", "a") for i in range(40)] + [(7, words(100 + i, 20), "en", "b") for i in range(40)] + [(i % 2, "one two three four", "en", "c") for i in range(400)]
    got = corpus_pipeline.mix_stage(spark, table(spark, rows), "").collect()
    assert corpus_pipeline.mix_stage(spark, table(spark, rows[::-1]), "").subtract(spark.createDataFrame(got)).isEmpty()
    target = {r.source: r.target for r in mix_sources(table(spark, rows)).collect()}
    for source, target_words in target.items():
        taken = Counter(r.text for r in got if r.source == source)
        size = 4 if source == "c" else 20
        assert abs(sum(taken.values()) * size - target_words) <= size
        if source != "c":
            assert max(taken.values()) - min([taken[t] for _, t, _, s in rows if s == source]) <= 1
