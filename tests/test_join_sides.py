"""No side of a join that grows with the tables is broadcast because a stored or exploded table looks small."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """What is measured at run time may be broadcast, what is estimated may not: a broadcast of it fails."""
    wanted = {"spark.sql.maxBroadcastTableSize": "1b", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", [
    "char_boxes", "map_lines", "mapping_stats", "mapped_share", "near_misses", "nearest_cell", "unmapped_regions", "grid_coords", "shelf_pack_chained", "full_chain",
])
def test_sides_are_dealt_by_key(spark, no_broadcast, name):
    assert entry.queries()[name](spark, SF).count() > 0
