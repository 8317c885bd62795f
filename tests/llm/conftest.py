import pytest

#: Rows that every operator must take: nulls in every column, empty and blank texts, ties, repeated rows, a long text.
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the small house near the old river"


def doc_rows():
    words = PROSE.split()
    return [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (3, PROSE + " today", "en", None), (4, None, None, None),
        (5, "", "en", "c"), (6, "   \n\t ", "en", "c"), (7, "12 34 !!", "en", "d"), (8, "Straße für öl", "de", "d"),
        (9, " ".join(reversed(words)), "en", "e"), (9, " ".join(reversed(words)), "en", "e"),
        (10, "one two", None, "f"), (11, " ".join(words[i % 7] + str(i) for i in range(6000)), "en", "g"),
        (None, "nameless text of five words", "en", None), (12, "ÄÖÜ ÄÖÜ über die straße gehen wir", "de", "h"),
        (13, "THE QUICK BROWN FOX " + " ".join(words[4:]), "en", "h"),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def doc_list():
    return doc_rows()
