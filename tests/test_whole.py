"""Queries of the catalogue and the world read all of it: held, on the smallest tables, against tiles listed by hand."""

import __spark_entry__
from sparkdem.jobs import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    q = __spark_entry__.queries()
    land = {(r.tile_lat, r.tile_lon) for r in fx.catalogue(spark, SF).collect()}
    rasters = {(r.tile_lat, r.tile_lon) for r in fx.pixels(spark, SF).select("tile_lat", "tile_lon").distinct().collect()}
    world = {(a, b) for a in range(-60, 60) for b in range(-180, 180)}

    blocks = q["G2_enumerate_blocks"](spark, SF).collect()
    assert {(r.tile_lat, r.tile_lon) for r in blocks} == land
    assert {tuple(r) for r in q["J4_pending"](spark, SF).collect()} == world - land
    west = {r.tile_lat: (r.n, r.west) for r in q["X2_world_minus_land"](spark, SF).collect()}
    assert west == {a: (len(x), min(x)) for a in range(-60, 60) for x in [[b for b in range(-180, 180) if (a, b) not in land]]}
    ocean = q["G5_generate_ocean"](spark, SF).where("min_h = 0 and max_h = 0")
    assert {tuple(r) for r in ocean.select("tile_lat", "tile_lon").distinct().collect()} == world - land
    both = {(r.tile_lat, r.tile_lon): r.sum_h for r in q["X3_land_and_ocean"](spark, SF).collect()}
    assert both.keys() == world | rasters and {k for k, h in both.items() if h} <= rasters
    assert fx.blocks(spark, SF).selectExpr("sum(size(heights)) as n").first().n >= spark.read.parquet(f"{SF}/orders.parquet").count()
