"""Tables of six times sf0.1 stand for tiles beyond the globe: their results are the definitions' own there, too."""

import os

import numpy as np
from pyspark.sql import functions as F

from sparkdem.functions import codec, geo, names
from sparkdem.jobs import fixtures as fx
from sparkdem.jobs import queries
from sparkdem.operators import audit, grid
from sparkdem.sources import files


def orders(spark, path, keys):
    """A folder with a table of orders of these keys."""
    at = F.timestamp_seconds(F.lit(0))
    rows = keys.select(F.col("id").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("id") * 7919 % 4000 * 100.0).alias("o_totalprice"), at.alias("o_orderdate"), F.lit("1").alias("o_orderpriority"))
    rows.write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_positions_of_far_tiles(spark, tmp_path):
    d = orders(spark, tmp_path, spark.range(239 * 3750, 239 * 3750 + 700))
    points = queries.G3_grid_points(spark, d).collect()
    assert {r.tile_lat for r in points} == {239} and all(r.n == 28 * 32 and r.sum_lat > 239 * 10**7 * 896 for r in points)
    cells = queries.P15_index_to_latlon(spark, d).where("tile_lat = 250").collect()
    assert cells and all(2_500_000_000 <= r.lat_e7 < 2_510_000_000 for r in cells)
    origin = spark.range(1).select(geo.block_origin(F.lit(240), F.lit(3), F.lit(0), F.lit(100)).alias("o")).first().o
    assert (origin.lat_e7, origin.lon_e7) == (2_400_000_000, 30_000_000)
    assert grid.enumerate_blocks(spark.createDataFrame([(240, 0)], "tile_lat int, tile_lon int"), 1000).count() > 0


def test_blocks_read_all_tiles_that_they_reach(spark):
    # at 100 degrees a degree of longitude counts as short as can be, so blocks of the tile at 0 reach far to the east
    tiles = spark.createDataFrame([(100, k) for k in range(6)], "tile_lat int, tile_lon int")
    rows = tiles.selectExpr("tile_lat", "tile_lon", "25 as size", "explode(sequence(0, 24)) as y", "array_repeat(smallint(tile_lon + 1), 25) as h")
    got = grid.generate_blocks(rows, tiles.where("tile_lon = 0"), 1000).collect()
    points = grid.grid_points(grid.enumerate_blocks(tiles.where("tile_lon = 0"), 1000), 1000).collect()
    # rasters are level, so the height of a point is its tile's; beyond them, and north of them, is ocean
    want = {}
    for p in points:
        inside = p.lat_e7 < 1_010_000_000 and p.lon_e7 < 60_000_000
        want.setdefault(p.blocknum, [0] * 896)[p.gx * 32 + p.gy] = p.lon_e7 // 10_000_000 + 1 if inside else 0
    assert {r.blocknum: list(r.heights) for r in got} == want
    assert {6, 0} <= {h for x in want.values() for h in x}


def test_tiles_that_are_read_and_readers_agree(spark):
    tiles = spark.createDataFrame([(a, 10) for a in (-85, -60, 0, 59, 84, 100, 269, 359)], "tile_lat int, tile_lon int")
    for spacing in (30, 100, 1000):
        for t in tiles.collect():
            one = tiles.where(f"tile_lat = {t.tile_lat}")
            sources = grid.read_by(one, spacing)
            back = grid.readers(sources, spacing).where(f"for_lat = {t.tile_lat} and for_lon = 10")
            assert back.count() == sources.count()
    usual = grid.read_by(spark.createDataFrame([(40, 10)], "tile_lat int, tile_lon int"), 30).collect()
    assert {tuple(r) for r in usual} == {(40, 10), (40, 11), (41, 10), (41, 11)}


def test_files_of_far_tiles(spark, tmp_path):
    lats = [99, 100, 120, 128, 213, 214, 215, 251, 2511]
    blocks = spark.createDataFrame([(a, n) for a in lats for n in (0, 2)], "lat int, n int").selectExpr(
        "lat as tile_lat", "0 as tile_lon", "n as blocknum", "72057594037927935 as bitmap", "lat * 10000000L + n as lat_e7", "n * 2000 as lon_e7", "1 as version", "100 as spacing",
        "array_repeat(smallint(lat), 896) as heights", "n div 2 as grid_idx_x", "n % 2 as grid_idx_y", "0 as lon_degrees", "lat as lat_degrees", "1 as version_minor",
    )
    files.write_dat(blocks, str(tmp_path)).collect()
    assert [r.tile_lat for r in files.scan_tiles(spark, str(tmp_path)).collect()] == lats
    back = files.read_dat(spark, str(tmp_path)).collect()
    found = {(r.lat_degrees, r.blocknum, r.lat_e7, r.heights[0]) for r in back if r.version}
    assert found == {(a, n, a * 10**7 + n, a) for a in lats for n in (0, 2)}
    assert {(r.lat_degrees, r.lat_e7) for r in back if not r.version} == {(0, 0)} and len(back) == 3 * len(lats)  # the gaps
    reasons = files.stored_checks(spark, str(tmp_path), 100).collect()
    assert {(r.tile_lat, r.blocknum): r.reason for r in reasons} == {(a, n): "zero_header" if n == 1 else None for a in lats for n in range(3)}


def test_stored_positions(spark):
    # of tiles that the field can hold a position stands as it is, right or wrong
    cases = [(5, 50_000_000, 50_000_000), (-5, (1 << 32) - 50_000_000, -50_000_000), (80, (1 << 32) - 2_000_000_000, -2_000_000_000), (251, 2_510_000_001, 2_510_000_001), (2511, 25_110_000_003 % (1 << 32), 25_110_000_003)]
    got = spark.createDataFrame(cases, "degree int, field long, want long").select(geo.whole_position("field", "degree").alias("p"), "want").collect()
    assert all(r.p == r.want for r in got)
    assert codec.whole(np.array([-2_000_000_000, 5]), 32, 800_000_000, 10_000_000).tolist() == [-2_000_000_000, 5]


def test_names_of_far_tiles(spark):
    one = spark.range(1).select(names.tile_name(F.lit(115), F.lit(0), ".DAT").alias("n")).select("n", names.parse_tile_name(F.col("n"), "stored_prefix").alias("t"), names.parse_tile_name(F.col("n"), "prefix").alias("p")).first()
    assert (one.n, tuple(one.t), one.p) == ("N115E000.DAT", (115, 0), None)


def test_steepness_of_rows_in_any_order(spark):
    # rows of one partition that a source gives in another order each time, as a shuffle's fetches may
    def run(batches):
        for b in batches:
            yield b.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "little"))

    rng = np.random.default_rng(3)
    rasters = {t: rng.integers(0, 5000, (25, 25)) for t in range(12)}
    data = [(t, 0, 25, y, [int(v) for v in r[y]]) for t, r in rasters.items() for y in range(25)]
    schema = "tile_lat int, tile_lon int, size int, y int, h array<smallint>"
    rows = spark.createDataFrame(data, schema).repartition(2).mapInPandas(run, schema)
    want = {t: (int((np.abs(np.diff(r, axis=0)) > 2000).sum() + (np.abs(np.diff(r, axis=1)) > 2000).sum()), int(max(np.abs(np.diff(r, axis=a)).max() for a in (0, 1)))) for t, r in rasters.items()}
    for _ in range(3):
        assert {r.tile_lat: (r.steep, r.max_diff) for r in audit.steep_hgt(rows, 2000).collect()} == want


def test_rasters_of_far_tiles(spark, tmp_path):
    d = orders(spark, tmp_path / "tables", spark.range(120 * 3750 + 600, 120 * 3750 + 660))
    rows = fx.full_raster(spark, d)
    written = files.write_hgt(rows, str(tmp_path / "hgt"))
    plan = written._jdf.queryExecution().executedPlan().toString()
    # rows are dealt while they are small: no exchange stands between widening and writing
    assert "Exchange" not in plan[: plan.index("Generate")]
    assert {(r.name, r.status) for r in written.collect()} == {("N120E000.hgt", "ok"), ("N120E001.hgt", "ok")}
    assert all(os.path.getsize(tmp_path / "hgt" / f) < 200_000 for f in os.listdir(tmp_path / "hgt") if f.endswith(".zip"))  # of 2,884,802 bytes
    want = {(r.tile_lat, r.tile_lon, r.y): r.h for r in rows.collect()}
    back = files.read_hgt(spark, str(tmp_path / "hgt")).collect()
    assert {(r.tile_lat, r.tile_lon, r.y): r.h for r in back} == want and len(back) == 2 * 1201 == sum(r.size == 1201 for r in back)
    assert all(len(h) == 1201 for h in want.values()) and {min(h) for h in want.values()} >= {geo.VOID}


def test_stream_of_far_rasters(spark, tmp_path):
    d = orders(spark, tmp_path, spark.range(220 * 3750 + 600, 220 * 3750 + 650))
    got = queries.T2_stream_generate(spark, d).collect()
    assert {(r.tile_lat, r.tile_lon): r.differing for r in got} == {(220, 0): 0, (220, 1): 0} and all(r.blocks > 0 for r in got)
