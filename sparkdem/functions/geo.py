"""Positions in 1e-7 degrees (e7), metres, and grid blocks: Column to Column, all inside whole-stage code generation.

Integers of e7 are BIGINT. Truncation is a cast, Python's // is floor, its round is rint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid: metres for 1e-7 degrees and its inverse (both single precision), block rows and columns, and
# the step from block to block (one square and more overlap).
M_PER_E7, E7_PER_M = 0.011131884530186653, 89.83204650878906
ROWS, COLS, STEP_N, STEP_E = 28, 32, 24, 28
FULL_BITMAP, BLOCK_BYTES, DATA_BYTES, VOID = (1 << 56) - 1, 2048, 1821, -32768


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def f32(c: Column) -> Column:
    return c.cast("float").cast("double")


def truncated(c: Column) -> Column:
    return c.cast("bigint")


def corner_e7(degree) -> Column:
    """The position of a whole degree; a BIGINT, also of an INT degree whose position is beyond INT."""
    return _c(degree).cast("bigint") * 10_000_000


def longitude_scale(lat) -> Column:
    return F.greatest(f32(F.cos(f32(F.radians(_c(lat))))), F.lit(0.01))


def diff_longitude_e7(a, b) -> Column:
    d = _c(a) - _c(b)
    wrapped = F.when(d > 1_800_000_000, d - 3_600_000_000).when(d < -1_800_000_000, d + 3_600_000_000).otherwise(d)
    same = F.signum(_c(a).cast("double")) * F.signum(_c(b).cast("double")) >= 0
    return F.when(same, d).otherwise(wrapped)


def distance_ne(lat1, lon1, lat2, lon2, fmt: str = "4.1") -> Column:
    """Struct of metres north and east."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    if fmt == "pre-4.1":
        north, east = (lat2 - lat1) * M_PER_E7, (lon2 - lon1) * M_PER_E7 * longitude_scale(lat1 * 1.0e-7)
    else:
        north, east = (lat2 - lat1) * M_PER_E7, diff_longitude_e7(lon2, lon1) * longitude_scale((lat1 + lat2) * 0.5 * 1.0e-7) * M_PER_E7
    return F.struct(north.alias("north"), east.alias("east"))


def add_offset(lat, lon, north, east, fmt: str = "4.1") -> Column:
    """Struct lat_e7, lon_e7 after so many metres; lat and lon may be fractional, and are truncated after adding."""
    lat, lon, north, east = (_c(x).cast("double") for x in (lat, lon, north, east))
    dlat = truncated(north * E7_PER_M)
    scale = longitude_scale(lat * 1.0e-7 if fmt == "pre-4.1" else (lat + dlat * 0.5) * 1.0e-7)
    dlon = truncated(east * E7_PER_M / scale)
    return F.struct(truncated(lat + dlat).alias("lat_e7"), truncated(lon + dlon).alias("lon_e7"))


def east_blocks(lat_e7, lon_e7, spacing, fmt: str = "4.1") -> Column:
    """Blocks in a row of a tile's file."""
    lat, lon, spacing = map(_c, (lat_e7, lon_e7, spacing))
    end = add_offset(lat, lon + 10_000_000, F.lit(0), 2 * spacing * COLS, fmt)
    return truncated(distance_ne(lat, lon, end["lat_e7"], end["lon_e7"], fmt)["east"] / (spacing * STEP_E))


def block_origin(tile_lat, tile_lon, blocknum, spacing, fmt: str = "4.1") -> Column:
    """Struct lat_e7, lon_e7 of a block's south-west corner."""
    lat, lon, num, spacing = corner_e7(tile_lat), corner_e7(tile_lon), _c(blocknum), _c(spacing)
    stride = east_blocks(lat, lon, spacing, fmt)
    return add_offset(lat, lon, F.floor(num / stride) * STEP_N * spacing, F.pmod(num, stride) * STEP_E * spacing, fmt)


def block_of_point(lat_e7, lon_e7, spacing, fmt: str = "4.1") -> Column:
    """Struct of the tile, block and place in the block of a point."""
    lat, lon, spacing = _c(lat_e7), _c(lon_e7), _c(spacing)
    tile_lat, tile_lon = F.floor(lat * 1e-7), F.floor(lon * 1e-7)
    ref_lat, ref_lon = tile_lat * 10_000_000, tile_lon * 10_000_000
    off = distance_ne(ref_lat, ref_lon, lat, lon, fmt)
    ix, iy = truncated(F.rint(off["north"]) / spacing), truncated(F.rint(off["east"]) / spacing)
    gx, gy = F.floor(ix / STEP_N), F.floor(iy / STEP_E)
    return F.struct(
        tile_lat.alias("tile_lat"), tile_lon.alias("tile_lon"), gx.alias("grid_idx_x"), gy.alias("grid_idx_y"),
        (ix - gx * STEP_N).alias("local_x"), (iy - gy * STEP_E).alias("local_y"),
        (east_blocks(ref_lat, ref_lon, spacing, fmt) * gx + gy).alias("blocknum"),
    )


def void_to(c, value) -> Column:
    return F.when(_c(c) == VOID, F.lit(value)).otherwise(_c(c))


def bilinear(h00, h10, h01, h11, fx, fy) -> Column:
    """East first, then north; where one side is null, the other."""

    def between(a, b, w):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(b * w + a * (1 - w))

    h00, h10, h01, h11, fx, fy = map(_c, (h00, h10, h01, h11, fx, fy))
    return between(between(h00, h10, fx), between(h01, h11, fx), fy)


def fill_height(c) -> Column:
    return _c(c).cast("int").cast("smallint")


def pixel_offset(x, y, size) -> Column:
    return _c(x) + _c(size) * (_c(size) - _c(y) - 1)


def grid_to_latlon(row, col, tile_lat, tile_lon, spacing) -> Column:
    """Approximate position of a mosaic's cell, for display."""
    row, col, lat, lon, spacing = map(_c, (row, col, tile_lat, tile_lon, spacing))
    return F.struct((lat + row * spacing / 111320.0).alias("lat"), (lon + col * spacing / (111320.0 * F.cos(F.radians(lat + 0.5)))).alias("lon"))


def index_to_latlon(lat_e7, lon_e7, idx, spacing, layout: tuple[int, int] = (32, 28), fmt: str = "4.1") -> Column:
    """Position of a flat height index, from its block's corner; layout is the rows and columns that the index is read by."""
    gx, gy = F.floor(_c(idx) / layout[1]), F.pmod(_c(idx), F.lit(layout[1]))
    return add_offset(lat_e7, lon_e7, gx * _c(spacing), gy * _c(spacing), fmt)


def whole_position(field, degree) -> Column:
    """A position of which a signed field of 32 bits (read without its sign) is stored, in the tile of that degree: as it stands where
    the field can hold the tile, and else the one next to the tile's corner with the same last bits."""
    at, signed = corner_e7(degree), (_c(field) + (1 << 31)).bitwiseAND((1 << 32) - 1) - (1 << 31)
    turns = F.shiftright(at - _c(field) + (1 << 31), 32)
    return F.when(at.between(-(1 << 31), (1 << 31) - 1 - 10_000_000), signed).otherwise(_c(field) + F.shiftleft(turns, 32))


def hgt_spacing(size) -> Column:
    return truncated(F.rint(111320 / (_c(size) - 1)))
