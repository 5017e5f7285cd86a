import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, shard int, h long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "re", "th", "ion", "el", "ö", "st", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and clashing extra columns."""
    rng = random.Random(11)
    texts = [sentence(rng, rng.randint(20, 160)) for _ in range(60)]
    shared = sentence(rng, 60)
    texts += [None, "", " \n\t ", "one", "a b c", "😀 Ünïcödé §§ \x1c x", "# * $ %" * 30, "word " * 400, sentence(rng, 30_000)]
    texts += [texts[3]] * 12 + [texts[5] + " tail", texts[5].replace("an", "AN"), shared, texts[7] + " " + shared, shared + "\n" + texts[9], texts[10] + "\n" + texts[10]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), 7, "x", None, 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id at all " * 5, None, None, None, None, None, None, None), (4, "another text of the same id", "en", "a", 1, 1, "y", 2, 3)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
