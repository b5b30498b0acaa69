"""Functions registered for SQL against the library's columns, row by row over whole tables and odd texts."""

import pytest
from pyspark.sql import functions as F

from folioflow import registry
from folioflow.functions import dates, numeric, text
from folioflow.operators import textops

ODD = ["", " ", "\t a  b \n", "o'neil mc-donald", "ÉCOLE éa 2nd x", None, "MIXED case1word", "a\u0001b", "<a href=\"x\">&'</a>"]
#: Calls and what makes their twin; columns are made where there is a session.
TWINS = {
    "xl_mod(n, k)": lambda: numeric.mod(F.col("n"), F.col("k").cast("double"))["v"],
    "xl_round(n, 1)": lambda: numeric.round_(F.col("n"), 1),
    "xl_quotient(n, k)": lambda: numeric.divide(F.col("n"), F.col("k").cast("double"))["v"],
    "xl_trim(s)": lambda: text.trim(F.col("s")),
    "xl_proper(s)": lambda: text.proper(F.col("s")),
    "xl_left(s, k)": lambda: text.left(F.col("s"), F.col("k")),
    "xl_mid(s, k, 3)": lambda: text.mid(F.col("s"), F.col("k"), 3)["v"],
    "xl_exact(s, upper(s))": lambda: text.exact(F.col("s"), F.upper("s")),
    "xl_serial(d)": lambda: dates.date_serial(F.col("d")),
    "tx_html_escape(s)": lambda: textops.html_escape(F.col("s")),
    "tx_safe_link(s)": lambda: textops.safe_link(F.col("s")),
}


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    registry.register(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("s"), (F.col("p_retailprice") - 1200).alias("n"), (F.col("p_size") % 5 - 1).alias("k"), F.expr("date'1999-12-30' + p_size").alias("d"))
    odd = spark.createDataFrame([(s, float(i) - 3, i - 2) for i, s in enumerate(ODD)], "s string, n double, k int").withColumn("d", F.expr("date'1900-02-27' + k"))
    return part.unionByName(odd)


@pytest.mark.parametrize("call", TWINS)
def test_sql_functions_are_their_columns(rows, call):
    got = rows.select("s", "n", "k", F.expr(call).alias("sql"), TWINS[call]().alias("column"))
    assert got.where(~F.col("sql").eqNullSafe(F.col("column"))).head(3) == []


def test_every_sql_function_has_a_twin():
    assert {f[0] for f in registry.SQL_FUNCTIONS} - {t.partition("(")[0] for t in TWINS} == {"xl_date"}


def test_dates_turn_back(rows):
    assert rows.where("not xl_date(xl_serial(d)) <=> d").head(1) == []
