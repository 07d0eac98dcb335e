"""Expanded spans are no small table, however few the spans."""

import pytest

from loomgrid.operators import formats
from loomgrid.staging import staged
from loomgrid.tensor import from_rows


@pytest.mark.parametrize("form", ["csr", "dcsr"])
def test_expanded_spans_are_not_broadcast(spark, form):
    t = from_rows(spark, [(0, k, k + 1) for k in range(500)] + [(2, 7, 5)], ["i", "k"], (3, 500))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = getattr(formats, f"from_{form}")(*[staged(x, form) for x in getattr(formats, f"to_{form}")(t)], ("i", "k"))
        plan = got.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # what is above the first expansion from the top has no broadcast
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and not [line for line in joins if "BroadcastHashJoin" in line and "pos" in line]
    assert {tuple(r) for r in got.rows.collect()} == {tuple(r) for r in t.rows.collect()}
