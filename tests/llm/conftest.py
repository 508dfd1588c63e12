import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size string, shard string, language string, rows int, _key string, label string, _id string, `a.b` string, `c``d` string"

LONG = " ".join(f"word{n % 5000} the of it{n}" for n in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and columns named as operators might name theirs."""
    rows = [
        (1, "The cat sat on the mat with a hat and looked at the moon", "en", "a"),
        (1, "The cat sat on the mat with a hat and looked at the moon", "en", "a"),
        (2, "The cat sat on the mat with a hat and looked at the moon", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b\x0c\r ", "fr", ""),
        (None, "Der Hund und die Katze liegen im Haus von dem Mann", "de", "b"),
        (None, None, None, None),
        (7, LONG, "en", "a"),
        (8, "1234 5678 -- !!", "en", "c"),
        (9, "ÀÉÎ straße 日本語 \U0001f600 le chat est sur la table et dort", "fr", "c"),
        (10, "Word", "en", "a"),
        (1, "another text with the first id", "en", "a"),
    ]
    clash = ("k", "s", "h", "l", 1, "x", "y", "z", "dotted", "quoted")
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *clash) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def records(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]
