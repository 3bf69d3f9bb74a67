import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, size string, key int, words int, spans string, digest int, shard int, label int"
EXTRA = ("x", 1, "s", 2, 3, "sp", 4, 5, 6)


def passage(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho"]) + str(rng.randint(0, 40)) for _ in range(n))


def odd_rows():
    """Nulls, empties, white space, copies, near copies, shared passages and a long text."""
    rng = random.Random(3)
    base, shared = passage(rng, 120), passage(rng, 70)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (None, None, None, None),
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\n ", None, "b"),
        (4, base, "en", "a"),
        (5, base, "en", "a"),
        (5, base, "en", "a"),
        (6, " ".join(near), "de", "b"),
        (7, passage(rng, 30) + "\n" + shared + "\n" + passage(rng, 40), "en", "c"),
        (8, shared + "\nnew line. " + passage(rng, 10), "en", "a"),
        (None, base, "en", "a"),
        (None, "short one.", "en", "a"),
        (9, "one two", "en", "a"),
        (10, "One TWO", "en", "b"),
        (11, "ééé 日本語 слово x " * 30, "xx", "é"),
        (12, passage(rng, 6000), "en", "a"),
        (13, ("in " * 400).strip(), "en", "b"),
        (9, "another text under one id", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(11)
