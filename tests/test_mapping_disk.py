"""What mapping lines to cells leaves on disk on its way: lines are dealt once, and shuffles go when they are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from regionflow.operators import mapping
from regionflow.plans import catalog, chain_queries, mapping_queries, registry
from regionflow.session import cut_lineage, temporary_tables

SF = "/root/testdata/sf0.001"
CELLS = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in mapping.CELL_FIELDS)
LINES = "doc_id bigint, line_no bigint, batch_idx bigint, text string, x double, y double, width double, height double, cell_idx bigint"


def dealt(df, column):
    """Exchanges that rows with ``column`` go through."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [i for i in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) if re.search(rf"\b{column}#", i)]


@pytest.mark.parametrize("name, most", [("map_spatial", 2), ("map_lines", 1), ("near_misses", 1), ("mapped_share", 0), ("unmapped_regions", 0), ("map_by_cell", 1), ("mapping_stats", 0), ("char_boxes", 2)])
def test_lines_are_dealt_once(spark, name, most):
    """Those that a cell was found for once more, by their key."""
    assert name in catalog.QUERIES
    with temporary_tables(spark):
        assert len(dealt(registry.BUILDS[name](spark, SF), "line_no")) <= most


@pytest.mark.parametrize("name", ["nearest_cell", "full_chain"])
def test_lines_are_stored_once(spark, monkeypatch, name):
    """Only those that are left for the next step."""
    stored = []

    def noted(df, *args):
        stored.extend(c for c in df.columns if c == "line_no")
        return cut_lineage(df, *args)

    for module in (mapping, mapping_queries, chain_queries):
        monkeypatch.setattr(module, "cut_lineage", noted)
    with temporary_tables(spark):
        registry.BUILDS[name](spark, SF)
    assert len(stored) == 1


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if str(files.apply(i)).endswith(".data")}


def test_a_stored_table_leaves_no_shuffle(spark):
    before = shuffled(spark)
    with temporary_tables(spark):
        stored = cut_lineage(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
        assert not shuffled(spark) - before
        assert stored.filter("count = 100").count() == 1000


def test_a_key_that_comes_twice_is_one_line(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 50, 50, 0, 0, 0, 0)], CELLS)
    line = (0, 1, 0, "カナ", 10.0, 10.0, 20.0, 10.0, None)
    lines = spark.createDataFrame([line, line, (0, 2, *line[2:])], LINES)
    assert sorted(r.line_no for r in mapping.spatial_matches(lines, cells).collect()) == [1, 2]
    assert sorted(r.line_no for r in mapping.map_lines(lines, cells).collect()) == [1, 1, 2]


def test_lists_and_tiles_give_the_same_lines(spark, monkeypatch):
    rnd = random.Random(21)
    cells, k = [], 0
    for doc, n in ((0, 3), (1, 40), (2, 140)):
        for _ in range(n):
            x, y = rnd.randint(-50, 1500), rnd.randint(-50, 900)
            cells.append((doc, None if k % 9 == 0 else k % 3, k, k % 5, k, x, y, x + rnd.randint(10, 300), y + rnd.randint(10, 200), k, k + 1, 2, 3))
            k += 1
    some = lambda v, none: None if rnd.random() < none else v
    lines = [
        (some(rnd.randint(0, 3), 0.05), i, some(rnd.randint(0, 3), 0.2), some(rnd.choice(["カナ", "12", ""]), 0.05),
         some(float(rnd.randint(-200, 1700)), 0.1), some(float(rnd.randint(-200, 1100)), 0.05), some(rnd.choice((0.0, 30.0, 900.0, 20000.0)), 0.05),
         some(rnd.choice((0.0, 20.0, 700.0)), 0.05), some(rnd.randint(0, 200), 0.6))
        for i in range(600)
    ]
    cdf, ldf = spark.createDataFrame(cells, CELLS), spark.createDataFrame(lines, LINES)
    for unknown in (True, False):
        seen = []
        for few in (50, 1000):
            monkeypatch.setattr(mapping, "FEW_CELLS", few)
            mapped = mapping.map_lines(ldf, cdf, unknown_batches=unknown).collect()
            rows = {r.line_no: r.asDict() for r in mapped}
            assert len(rows) == len(mapped) == len(lines)
            placed = {r.line_no: (r.rule, r.cell_idx) for r in mapping.spatial_matches(
                ldf.filter("text = 'カナ'"), cdf, ["line_no"], unknown_batches=unknown, skip_named=True, carry=["text"]).collect()}
            assert placed == {i: (r["rule"], r["cell_idx"]) for i, r in rows.items() if r["outcome"] == "matched_bbox"}
            seen.append(rows)
        assert seen[0] == seen[1]
        assert {r["rule"] for r in seen[0].values()} == {None, 0, 1, 2, 3}
