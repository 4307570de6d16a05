"""Shape of physical plans: pruned scans, no cross joins, no whole-document windows."""

import pytest

from regionflow.operators import detect
from regionflow.plans import catalog
from regionflow.plans import fixtures as X
from regionflow.session import cut_lineage

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_filter_reaches_the_scan(spark):
    stored = cut_lineage(X.det(spark, SF))
    text = plan(detect.keep_detections(stored, 1).select("doc_id", "page_idx", "x1"))
    assert "GreaterThan(score,0.5)" in text and "EqualTo(label,1)" in text
    assert "x2" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize(
    "name", ["reading_order", "region_numbers", "map_spatial", "text_cut_batches", "edge_white", "dilate_mask"]
)
def test_no_cross_joins(spark, name):
    text = plan(catalog.BUILDS[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_text_columns_are_not_read_for_layout(spark):
    text = plan(X.regions(spark, SF))
    assert "l_returnflag" not in text and "l_shipdate" not in text
