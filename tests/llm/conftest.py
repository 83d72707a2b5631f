import pytest

from auditframe.llm.ship import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


#: Texts that every operator must take: null, empty, blanks, ties, a long one, odd characters.
ODD = [None, "", " \n\t ", "x", "x", "word " * 3000, "a▁b \U0001f642 \x1c\x85 ÉÉ", "!!! ??? ###", "One line.\nOne line.\n\nOne line."]


@pytest.fixture
def odd(spark):
    """Odd texts with null and repeated ids and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD)] + [(None, "some more words", "fr", 1), (3, "x", "en", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, score int")
