import random

import pytest

CLASHING = ("t1 string, text string, doc_id long, n_words string, kept int, uid string, drop string, found string, "
            "label string, n string, first string, h string")


@pytest.fixture
def table(spark):
    """Documents of (doc_id, text) rows, with null columns of names that operators use."""
    def make(rows):
        return spark.createDataFrame([(None, t, i, *[None] * 9) for i, t in rows], CLASHING)
    return make


@pytest.fixture(scope="session")
def prose():
    """A text of invented words."""
    def make(seed, words):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice(["ka", "lo", "mi", "ter", "ung", "é"]) for _ in range(draw.randint(1, 4)))
                        + draw.choice(["", "", "", "", "."]) for _ in range(words))
    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def rows():
    return rows_of
