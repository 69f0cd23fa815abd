import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, word string, shard string, fp string, size string"
#: Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own.
LONG = "Anedth onea the " * 20_000
ROWS = [
    (0, "the cat sat on the mat and looked at the dog", "en", "a", 44),
    (1, "The cat SAT on the mat and looked at the dog", None, "a", 44),
    (2, None, "en", None, None),
    (3, "", "en", "b", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, "one", "en", "a", 3),
    (5, "one", "en", "a", 3),
    (None, "one two", "fr", "a", 7),
    (7, "émoji 🙂 <|endoftext|> don't\t  x²  12 \n\n ", "fr", "c", 5),
    (8, "don't stop  believing ¼ ʼn 中文 字", "fr", "c", 5),
    (9, "  \n\t ", "fr", "c", 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "s", "f", "n") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
