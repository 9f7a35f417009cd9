import pytest

LONG = "wort " * 30_000
NEAR = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, NEAR, "en", "a"),
        (2, NEAR + " eleven", "en", "a"),
        (3, NEAR, None, None),
        (3, NEAR, None, None),
        (4, None, "de", "b"),
        (5, "", "de", None),
        (6, " \t\n", None, "b"),
        (7, LONG, "de", "a"),
        (None, NEAR, "en", "a"),
        (None, None, None, None),
        (8, "two words", "en", "c"),
        (8, "quite another text, of the same id", "fr", "c"),
        (9, "1234 5678 90.12.3.4 a@b.c +1 (222) 333-4444 4111 1111 1111 1111!", "en", "c"),
        (10, "99999999999999999999.1.1.1 x@y +12 " + "7" * 5000 + " a.b.c@d.e.f.g@h.i", "en", "c"),
        (11, "ΑΣ it's ÀÉ<|endoftext|> \u00a0\u2003x \U0001f600 ' s", "en", "c"),
    ]
    clash = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, ids string, rejected string, pii string, shard string, slot string, component_id string, host string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 1.0, "x", "x", "x", "x", "x", "x", "x") for r in rows], clash)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
