"""Plans: what reaches the scan, where rows are shuffled, and what never appears."""

import re

import pytest

from fieldgrid import catalog

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "attr_filter")
    pushed, schema = re.search(r"PushedFilters: \[([^\]]*)\]", p)[1], re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "GreaterThanOrEqual(l_quantity,45.0)" in pushed and "GreaterThan(l_discount,0.05)" in pushed
    assert sorted(x.split(":")[0] for x in schema.split(",")) == ["l_discount", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]
    assert "Exchange" not in p


@pytest.mark.parametrize("name", ["ndvi", "msavi", "arvi", "et0_ten_day", "sun_position", "iaqi", "aqi_level", "quadkey", "poly_area", "color_map", "round_hour", "json_props"])
def test_expressions_need_no_shuffle_and_no_python(spark, name):
    p = plan(spark, name)
    assert not re.search(r"Exchange (hash|range|Single)|Python|Pandas|Arrow", p)


@pytest.mark.parametrize("name", ["pip_join", "within_buffers", "box_overlay", "self_overlay", "asof_nearest", "bilinear", "glcm", "point_window_mean", "raster_at_points", "mosaic_nodata", "proximity"])
def test_joins_of_data_are_equi_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


@pytest.mark.parametrize(("name", "most"), [("focal_mean", 2), ("erode", 2), ("slope", 2), ("gauss_sep", 2), ("zonal_mode", 2), ("max_per_group", 1), ("upsert_latest", 1), ("zonal_stats", 1)])
def test_shuffles(spark, name, most):
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan(spark, name))) <= most


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_no_row_at_a_time_python(spark, name):
    if not name.startswith("stream"):  # these run their stream when they are asked for
        assert "BatchEvalPython" not in plan(spark, name)
