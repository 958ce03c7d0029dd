import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, band int, key long, node long, component long, slot long, id string, score double, start long, bucket string, live string, base string"
EXTRA = ("r", 1, 2, 3, 4, 5, "i", 0.5, 6, "b", "l", "z")


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rng = np.random.default_rng(1)
    base = words(rng, 120)
    near = base.copy()
    near[60] = "changed"
    long = " ".join(words(rng, 30_000))
    rows = [
        (1, " ".join(base), "aa", "s1"), (2, " ".join(near), "aa", "s1"), (2, " ".join(near), "aa", "s1"), (3, " ".join(base), None, "s2"),
        (4, "", "aa", "s1"), (5, None, "bb", None), (6, "  \n\t ", "bb", "s2"), (7, long, "bb", "s2"), (8, "one two", "bb", "s2"), (9, "ONE  two", "aa", "s3"),
        (None, " ".join(base), "aa", "s1"), (10, "\u00e9\u00e8 \U0001f600 password = hunter2hunter", "aa", "s1"), (11, "12345 !!", None, None), (10, "another text with the id ten", "bb", "s1"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
