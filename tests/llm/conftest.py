import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "der die das und the of and la le el que de en haus road river stone cloud light night garden window forest bridge market summer winter water paper silver copper".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): nulls in every column, empty and long texts, ties, repeated rows, copies and near copies, shared passages, several scripts."""
    rng = random.Random(5)
    passage = sentence(rng, 40)
    base = sentence(rng, 120)
    out = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "One", "en", "b"), (5, "one", "en", "b"), (6, "Straße ÄÖ é 日本語のテキスト です", "de", "b"), (6, "Straße ÄÖ é 日本語のテキスト です", "de", "b"),
        (None, "a row without an id " + base, "en", "c"), (8, "12345 !!! 67 --", "en", "c"), (9, "77 --", "en", "c"), (None, "88 --", "en", "c"), (9, base, "en", "c"), (10, base.upper(), "en", "c"), (11, base + " tail", "en", "a"), (12, base, "en", "a"),
        (13, "x" * 3000, None, "d"), (14, "x" * 3000 + "y", None, "d"), (15, sentence(rng, 20_000), "en", "d"), (16, "один два три четыре пять", "ru", "d"), (17, "\u0000odd\u2028 text\r\nhere", "en", "d"),
    ]
    for i in range(20, 60):
        out.append((i, f"{sentence(rng, rng.randint(1, 60))} {passage if i % 4 == 0 else ''} {sentence(rng, rng.randint(1, 60))}", rng.choice(["en", "de", "es"]), rng.choice(["a", "b", "ß", "Z"])))
    for i in range(60, 75):
        words = base.split()
        words[i % 100] = "changed"
        out.append((i, " ".join(words), "en", "near"))
    rng.shuffle(out)
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("key", pa.string()), ("size", pa.int32()), ("h", pa.int64())])


def write_documents(folder, rows):
    """The table with three more columns whose names the operators use inside."""
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    table = pa.table([list(cols[0]), list(cols[1]), list(cols[2]), list(cols[3]), [len(t or "") for t in cols[1]], [None] * len(rows), [7] * len(rows), [None] * len(rows)], schema=SCHEMA)
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, folder / "documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory, rows):
    return write_documents(tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write_documents(folder, [])
    pq.write_table(pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())], names=["page_id", "url", "html"]), folder / "pages.parquet")
    pq.write_table(pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float32())), pa.array([], pa.int32())], names=["vec_id", "embedding", "label"]), folder / "embeddings.parquet")
    return str(folder)
