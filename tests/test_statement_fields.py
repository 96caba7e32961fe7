"""Declarant, firm and fee of financial statements."""

import pytest
from pyspark.sql import functions as F

from karst.records import parse

OATH = "STATUTORY DECLARATION I, {0}, {1} do solemnly declare under the Statutory Declarations Act"
TOLD = "Disclosure whether the {0} director is also primarily responsible for financial management of the company {1}rimarily responsible for financial management of the company"


@pytest.mark.parametrize(("text", "want"), [
    (OATH.format("alice", "being the director"), ("ALICE", None)),
    (OATH.format("12345", "x") + " by the above-named EVE at TOWN", ("EVE", None)),
    (TOLD.format("first", "P") + " " + TOLD.format("second", "Not P"), ("ALICE", None)),
    (TOLD.format("first", "P") + " " + TOLD.format("second", "P"), (None, "MULTIPLE_RESPONSIBLE_DIRECTORS")),
    (OATH.format("ALICE", "a director") + " " + TOLD.format("second", "P"), (None, "DECLARANT_CONFLICT")),
    ("FS-EPC Name of director who signed certificate of exempt private company BOB Type of identification of director", ("BOB", None)),
    ("STATUTORY DECLARATION for rectification only", (None, None)),
    (None, (None, None)),
])
def test_declarant(spark, text, want):
    rows = spark.createDataFrame([(text, "ALICE", "BOB")], "text string, first_director string, second_director string")
    r = parse.with_declarant(rows).first()
    assert (r.declarant, r.declarant_issue) == want


@pytest.mark.parametrize(("text", "firm", "fee"), [
    ("Name of audit firm ONE PLT Address line 1", "ONE PLT", None),
    ("x\nTWO & CO (AF 0123)\ny", "TWO & CO", None),
    ("Director's remuneration\nFees (1,200)\nTotal Director's remuneration", None, -1200.0),
    ("Group Company\nDirector's remuneration\nFees 1 2 3 4", None, 3.0),
    ("Fees 5", None, None), ("", None, None), (None, None, None),
])
def test_firm_and_fee(spark, text, firm, fee):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(parse.audit_firm(F.col("t")).alias("firm"), parse.director_fee(F.col("t")).cast("double").alias("fee")).first()
    assert (r.firm, r.fee) == (firm, fee)


def test_a_firm_is_no_plausible_person(spark, tmp_path):
    from karst.plans.queries import QUERIES

    spark.range(4).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.name, r.plausible) for r in QUERIES["statement_names"](spark, str(tmp_path)).collect()} == {("Tan & Co", False), (None, False), ("ALICE", True)}


def test_a_declaration_is_looked_for_in_one_split(spark):
    plan = spark.range(1).select(parse.declaration(F.concat(F.lit("a "), F.col("id"))).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("STATUTORY DECLARATION),") == 1
