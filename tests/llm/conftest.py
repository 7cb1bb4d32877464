import random

import pytest

WORDS = "the of and that in was over seen river stone light under paper garden window music letter bridge cloud winter".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, odd texts, nulls."""
    long = prose(99, 30_000)
    texts = [prose(i, 60 + 7 * i) for i in range(30)]
    texts += [texts[3], texts[3], texts[4] + " extra word here", texts[5].upper()]
    texts += ["", None, " \t\n", "!!! ... ???", "word", "two words", "Ünïcödé ß 文字 😀 text", long, "\x00 odd \x7f", "a" * 5000]
    out = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], (None, "text without an id", None, None, None), (None, texts[3], None, None, None), (None, None, None, None, None)]
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["fp", "v", "grid", "cell", "score", "spans", "n_words", "items", "block", "chunk", "idx", "word", "label", "x", "start", "end", "component", "least", "reference", "host", "held_out", "lang_pred", "_score", "_attention", "_fp", "_component", "_place", "_part", "_parts", "_bad_id", "_bad_key", "_key", "key", "_text", "_chunks", "_email", "_ip", "_card", "_phone", "_loose_email", "_spans", "_items", "_words", "_hits"]
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    """A folder of the tables the queries read."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, prose(0, 40)), (2, "two words"), (2, "two words"), (3, None), (None, "seen river stone")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(30)] + [(3, 1, 0), (None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at
