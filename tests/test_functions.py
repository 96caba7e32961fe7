import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.functions import values as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.name_key, "  Alice & Bob\tSdn. Bhd. ", "ALICE BOB SDN BHD"),
    (T.entity_key, "Alice & Bob", "ALICE AND BOB"),
    (T.name_key, "Straße", "STRASSE"),
    (T.name_key, None, None),
    (T.auditor_key, "Y H Tan & Co", "YH TAN AND CO"),
    (T.identity_key, "800101-01-1234", "800101011234"),
    (T.null_if_nothing, " NaN ", None),
    (T.null_if_nothing, "-", None),
    (T.clean, "a  b­c ", "a b-c"),
    (T.clean_lines, " a \n\n b ", "a\nb"),
    (T.display_name, "ALICE O'NEIL A/L BOB-RAY", "Alice O'Neil A/L Bob-Ray"),
    (T.format_identity_number, "800101011234", "800101-01-1234"),
    (T.format_identity_number, "A123", "A123"),
    (T.safe_filename, "a/b:c", "a-b-c"),
    (T.registration_tokens, "202001000001 (123456-A)", ["202001000001", "123456A"]),
    (T.significant_tokens, "ALPHA BETA SDN BHD M", ["ALPHA", "BETA"]),
    (V.parse_date, "1/2/2024", dt.date(2024, 2, 1)),
    (V.parse_date, "2024-02-01", dt.date(2024, 2, 1)),
    (V.parse_date, "31/02/2024", None),
    (V.parse_integer, "RM 1,234.50", 1234),
    (V.parse_integer, "none", None),
    (V.parse_money, "(1,250.50)", Decimal("-1250.50")),
    (V.parse_money, "-", Decimal("0.00")),
    (V.parse_money, "x", None),
    (V.parse_percent, "12.5%", 12.5),
    (V.parse_percent, "", 0.0),
    (V.parse_count, "3", 3),
    (V.parse_count, "-3", None),
    (V.source_date, "report 5-3-2024 v2 2024-01-09.pdf", dt.date(2024, 3, 5)),
    (V.year_end, "year ended 30th June", "30 JUNE"),
    (V.year_end, "June 30", "30 JUNE"),
    (V.year_end, "in June", "JUNE"),
    (V.year_end, "all of them", "ALL"),
    (V.year_end, "nothing", None),
])
def test_scalar(spark, f, given, want):
    assert one(spark, given, f) == want


def test_percentage_rounds_halves_to_even(spark):
    got = spark.sql("select cast(0.125 as decimal(10,3)) a, cast(0.135 as decimal(10,3)) b").select(V.percentage(F.col("a")), V.percentage(F.col("b"))).first()
    assert tuple(got) == ("0.12%", "0.14%")


def test_registration_state(spark):
    rows = spark.createDataFrame([("202001000001", "123456-A / 202001000001"), ("", "123456-A"), ("654321-B", "123456-A")], "d string, m string")
    assert [r[0] for r in rows.select(T.registration_state(F.col("d"), F.col("m"))).collect()] == [2, 1, 0]


def test_cents_go_by_the_double_and_keep_the_sign_of_zero(spark):
    df = spark.createDataFrame([(x,) for x in (-0.0, -0.001, 0.285, 1.005, -1234.5, None)], "x double")
    assert [r[0] for r in df.select(V.currency(V.cents(F.col("x")))).collect()] == ["RM-0.00", "RM-0.00", "RM0.28", "RM1.00", "RM-1,234.50", None]


def test_whole_texts_go_to_python_a_few_at_a_time(spark):
    rows = spark.createDataFrame([("ﬁne “x” — y",), (None,), ("",)], "x string")
    done = rows.select(V.nfkc(F.col("x")).alias("c"), V.nfkd(F.col("x")).alias("d"), V.wrapped(F.col("x"), 4).alias("l"))
    assert "ArrowEvalPython" not in done._jdf.queryExecution().executedPlan().toString()  # its batches have 10,000 rows, whatever their length
    assert [tuple(r) for r in done.collect()] == [('fine "x" - y', "fine “x” — y", ["ﬁne", "“x”", "— y"]), (None, None, []), ("", "", [])]
