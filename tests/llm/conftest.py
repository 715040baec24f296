import pytest

LONG = " ".join(f"word{i % 977} {'x' * (i % 7)}" for i in range(30_000))
#: Nulls, empty and blank texts, a very long one, ties, repeated rows, and columns whose names the operators use inside.
HARD = [
    (1, "The cat sat on the mat. It was warm there.\nA second line here.\nA third line here.\nA fourth one.", "en", "a", 10, 0.5, "k"),
    (2, "The cat sat on the mat. It was warm there.\nA second line here.\nA third line here.\nA fourth one.", "en", "a", 10, 0.5, "k"),
    (2, "The cat sat on the mat. It was warm there.\nA second line here.\nA third line here.\nA fourth one.", "en", "a", 10, 0.5, "k"),
    (3, None, "en", "b", None, None, None),
    (4, "", None, "b", 0, 0.0, ""),
    (5, " \t\n\x0b\x0c\r ", "en", None, 7, 0.0, ""),
    (None, "No id has this text, <|endoftext|> nor this token=abcdef0123456789abcdef0123", "en", None, 5, 0.1, "k"),
    (None, "one", "en", "a", 5, 0.1, "k"),
    (6, LONG, "en", "c", len(LONG), 0.1, "k"),
    (7, "ä é \U0001F600 ▁ ſ K \x85   x\x00y", "fr", "c", 5, 0.1, "k"),
    (8, "one two", "en", "c", 5, 0.1, "k"),
    (9, "ONE  two", "en", "c", 5, 0.1, "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
