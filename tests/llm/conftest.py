import pytest

#: Values of every row that operators must stand: nulls, empties, blanks, repeats, long texts.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "one two three"), (6, "one two three"), (7, "ONE two three"), (8, "x " * 30000), (9, "y" * 50000), (None, "no id"), (10, "ünïcode ▁ 漢字 😀 <|im_start|> </s>")]


@pytest.fixture
def odd(spark):
    """Odd rows, with extra columns of clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.selectExpr("*", "'a' as score", "1 as kept", "'b' as n_chars", "doc_id as component_id", "text as pii")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
