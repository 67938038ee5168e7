import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, component_id string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, white and very long texts, ties, repeated rows; extra columns with clashing names come with the schema."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b", None, None), (4, "one two three", "en", "b"), (4, "one two three", "en", "b"), (5, "ONE two three", "de", None),
        (None, "no id here at all", "en", "b"), (6, long, None, "a"), (7, long, "en", "c"), (8, "Ünï cödé ΑΣ Σ 東京 \x1c x \U0001f600 é", "de", "c"), (9, "x" * 5000, "en", "c"),
    ]
    return [(i, t, lang, s, len(t or ""), 7, "x", "y") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
