import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, hash long, spans string, part int"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t), "n", 7, "x", 1) for i, t in enumerate(texts)]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank, one word, very long, non-ASCII, exact and near copies, a shared passage, repeats in one text."""
    rng = random.Random(5)
    long, base, passage = sentence(rng, 3000), sentence(rng, 80).split(), sentence(rng, 30)
    near = [" ".join(base[:k] + ["zz"] + base[k + 1:]) for k in (3, 40, 77)]
    return [None, "", " \n\t ", "word", "Word", long, " ".join(base), *near, " ".join(base), "é è ñ  ß x",
            sentence(rng, 15) + "\n" + passage + ". " + sentence(rng, 9), passage + " " + sentence(rng, 25), "same " * 60,
            "!!! ???", "!!! ???", "a b c d", "A b, c. D", sentence(rng, 20), "x" * 5000]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    rows = rows_of(edge_texts, 10) + [(None, "a row without an id", "en", "s", 3, "n", 7, "x", 1)]
    rows += rows_of(edge_texts, 10)[6:7]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
