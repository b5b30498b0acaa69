"""Plans: columns and filters reach the scans, natives stay native, nothing is a product."""

import pytest

from folioflow.plans.inspect import operators, plan_text, pushed_filters, read_columns, shuffles
from folioflow.queries import QUERIES

PYTHON = ("wb_", "fn_", "sp_forms", "sp_marks", "sp_offsets", "sp_pieces", "ly_reading_order", "ly_bands", "ly_merge_chunks")


def test_flagship_plan(spark, sf_dir):
    df = QUERIES["xl_sumifs_lineitem"](spark, sf_dir)
    assert read_columns(df) == ["l_discount", "l_extendedprice", "l_linestatus", "l_quantity", "l_returnflag"]
    assert shuffles(df) == 1 and operators(df)["HashAggregate"] == 2


def test_filters_are_pushed(spark, sf_dir):
    df = QUERIES["xl_xlookup_default"](spark, sf_dir)
    assert any("GreaterThan(c_acctbal,9000.0)" in f for f in pushed_filters(df))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_natives_stay_native(spark, sf_dir, name):
    text = plan_text(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON):
        assert not any(x in text for x in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")), name
