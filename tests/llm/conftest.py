import pytest


@pytest.fixture(scope="session")
def spark(spark):
    from cellgrid.session import ship_package
    ship_package(spark)
    return spark


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id long, _th string, _text string, "
          "key string, n int, label string, ctx string, r string, a string, b string, node string, _doc string")


def prose(seed, n):
    import random
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", "!"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, shared ids, ties, and columns named like the operators' own."""
    shared = "This line is found in many documents and is long enough."
    base = prose(1, 120)
    texts = [(1, base), (2, None), (None, "abc Def"), (3, ""), (4, "dup dup " + base), (4, "dup dup " + base), (4, "other text"),
             (5, base), (6, base.replace("alpha", "ALPHA", 1)), (7, "\n\n \n"), (8, prose(2, 9000)), (9, "é" * 600), (10, "x " * 400),
             (None, None), (11, prose(3, 200)), (12, prose(3, 200) + " tail words here"), (13, "one"), (14, "one"), (15, "\x1c odd \x85 blanks\x0b")]
    texts += [(20 + i, prose(50 + i, 60) + "\n  " + (shared.upper() if i % 2 else shared) + "\t\n" + prose(90 + i, 20)) for i in range(6)]
    return [(i, t, None if (i or 0) % 3 == 0 else ("en" if (i or 0) % 2 else "de"), None, None, 7, "x", "y", "k", None, "l", None, "r", "a", "b", "node", "d")
            for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
