"""Statuses, summaries and options of operators, on small tables."""

import datetime

import pytest

from sparkdem.operators import audit, cells, grid


def test_cutoff_of_zero_mix(spark):
    blocks = spark.createDataFrame([(t, 0, [0, t]) for t in (1, 2, 3)] + [(4, 0, [0, 0])], "tile_lat int, tile_lon int, heights array<smallint>")
    day = lambda y: datetime.datetime(y, 1, 1)
    times = spark.createDataFrame([(1, 0, day(2025)), (2, 0, day(2027)), (4, 0, day(2025))], "tile_lat int, tile_lon int, mtime timestamp")
    assert {r.tile_lat: r.affected for r in audit.zero_mix(blocks).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert {r.tile_lat: r.affected for r in audit.zero_mix(blocks, times).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_bad_file_sizes(spark):
    rows = [(1, 0, 1, 5, 2048 * 3), (2, 0, 1, 5, 2048 + 1821), (3, 0, 1, 5, 2048 + 7), (4, 0, 0, 5, 2048)]
    blocks = spark.createDataFrame(rows, "tile_lat int, tile_lon int, version int, version_minor int, file_bytes long")
    assert {r.tile_lat: r.state for r in audit.version_minor_audit(blocks).collect()} == {1: "single", 2: "single", 3: "bad file size", 4: "no valid blocks"}


def test_summaries(spark):
    a = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("z", None)], "name string, content binary")
    b = spark.createDataFrame([("x", b"1"), ("y", b"3"), ("w", b"4"), ("z", b"")], "name string, content binary")
    assert tuple(audit.store_summary(a, b, "name", "content").first()) == (3, 2)
    results = spark.createDataFrame([(1, 0, 5, None), (2, 0, 0, None), (3, 0, None, "ValueError")], "tile_lat int, tile_lon int, steep long, error string")
    assert tuple(audit.steep_summary(results).first()) == (3, 1, 1) and [r.tile_lat for r in audit.unread(results).collect()] == [3]


def test_decimation_status(spark):
    rows = spark.createDataFrame([(1, 0, 3601), (2, 0, 1201), (3, 0, None)], "tile_lat int, tile_lon int, size int")
    assert {r.tile_lat: r.status for r in grid.decimate_status(rows).collect()} == {1: "ok", 2: "not SRTM1 (size=1201)", 3: "not SRTM1 (size=unknown)"}


def test_mosaics_of_two_spacings(spark):
    cells = lambda n, k: spark.range(n * n).selectExpr("0 tile_lat", "0 tile_lon", f"id div {n} row", f"id % {n} col", f"cast(id div {n} div {k} * 10 + id % {n} div {k} as smallint) h")
    diffs = audit.diff_mosaics(cells(6, 3), cells(2, 1), 30, 90)
    assert diffs.count() == 36 and diffs.where("diff <> 0").count() == 0
    assert audit.diff_mosaics(cells(2, 1), cells(6, 3), 90, 30).where("diff <> 0").count() == 0


def test_names_of_two_stores(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in ("xxyz", "yzzw"))
    assert {tuple(r) for r in audit.common_names(a, b, "name").collect()} == {("x", "first"), ("y", "both"), ("z", "both"), ("w", "second")}


def test_plans(spark):
    tiles = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "tile_lat int, tile_lon int")
    assert grid.planned_tiles(spark, "world", 0, 1).count() == 720
    assert grid.planned_tiles(spark, "existing", 0, 1, existing=tiles).count() == grid.planned_tiles(spark, "list", 0, 1, listed=tiles).count() == 2
    for mode in ("existing", "list", "other"):
        with pytest.raises(ValueError):
            grid.planned_tiles(spark, mode, 0, 1)


def test_cubic_resampling_keeps_the_pixels_that_stay(spark):
    """A cubic spline through all pixels, evaluated at every third: the conditions of interpolation leave it no choice."""
    rows = [(0, 0, 7, y, [(3 * y * y + 5 * x) % 101 for x in range(7)]) for y in range(7)]
    df = spark.createDataFrame(rows, "tile_lat int, tile_lon int, size int, y int, h array<smallint>")
    got = {r.y: r.h for r in grid.resample_cubic(df).collect()}
    assert got == {k: [(3 * (3 * k) ** 2 + 5 * x) % 101 for x in (0, 3, 6)] for k in range(3)}


def test_rows_beside_their_tile(spark):
    pixels = spark.createDataFrame([(0, 0, x, y, -32768 if (x, y) == (1, 0) else 10 * y + x) for y in range(2) for x in range(3)], "tile_lat int, tile_lon int, x int, y int, h int")
    assert {(r.x, r.y): (r.dx, r.dy) for r in cells.neighbour_differences(pixels).collect()} == {(0, 0): (None, None), (2, 0): (2, None), (0, 1): (None, 10), (1, 1): (1, None), (2, 1): (1, 10)}
    assert {(r.x, r.y): (r.above_least, r.below_most) for r in cells.beside_bounds(pixels).collect()}[1, 0] == (None, None)
    assert tuple(cells.first_of_the_largest(pixels.withColumn("h", pixels.y), pixels.y * 3 + pixels.x).first()) == (0, 0, 1, 0, 1)
    checked = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, "crc"), (0, 0, 2, None), (1, 0, 5, None)], "tile_lat int, tile_lon int, blocknum int, reason string")
    assert {(r.tile_lat, r.blocknum) for r in cells.before_first_bad(checked).collect()} == {(0, 0), (1, 5)}
    assert {tuple(r) for r in cells.last_writer(checked, ["tile_lat", "tile_lon"], "blocknum").collect()} == {(0, 0, 2, None), (1, 0, 5, None)}
