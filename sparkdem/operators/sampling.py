"""Heights at points: from rasters, from grid blocks, and both side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdem.functions import geo
from sparkdem.functions.geo import COLS, ROWS, STEP_E, STEP_N

TILE = ["tile_lat", "tile_lon"]


#: Keys in demand that are broadcast at most.
MOST_KEYS = 200_000


def demanded(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of table whose keys are asked for. Up to MOST_KEYS keys are broadcast, so the table isn't shuffled; beyond
    them both sides are, and arrays move only with keys that are asked for from there on."""
    wanted = keys.select(*on).distinct()
    few = wanted.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return table.join(F.broadcast(wanted) if few else wanted, on, "left_semi")


def raster_sizes(hgt_row: DataFrame) -> DataFrame:
    """tile, tile_size: at most 64,800 rows. Worth being written beside a large store, as it is asked for by every sampling."""
    return hgt_row.groupBy(*TILE).agg(F.max("size").alias("tile_size"))


def one_raster(hgt_row: DataFrame) -> DataFrame:
    """The rows of one raster of each tile: of several paths of a tile (column path, if there) the last counts."""
    if "path" not in hgt_row.columns:
        return hgt_row
    last = hgt_row.groupBy(*TILE).agg(F.max("path").alias("path"))
    return hgt_row.join(F.broadcast(last), [*TILE, "path"], "left_semi")  # at most 64,800 rows


def sample_hgt(points: DataFrame, hgt_row: DataFrame, keyed: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """points (lat_e7, lon_e7 and others) with h: the height in the tile they fall in, truncated.

    Voids count as -1. A tile that isn't there is ocean (0); a raster row that isn't there gives null. Raster rows that
    no point asks for are left out before arrays move; a point takes two heights of its row, then two of the next one.
    Of rasters of one tile, or raster rows of one place, one counts. keyed says that hgt_row is a table of write_keyed by
    RASTER_KEYS, which is joined as it stands: any number of points come to it, those of a stream too. sizes: its raster_sizes.
    """
    hgt_row = hgt_row if keyed else one_raster(hgt_row)
    tiles = raster_sizes(hgt_row) if sizes is None else sizes
    p = points.withColumns({"lat": F.col("lat_e7") * 1e-7, "lon": F.col("lon_e7") * 1e-7})
    p = p.withColumns({"tile_lat": F.floor("lat").cast("int"), "tile_lon": F.floor("lon").cast("int")})
    p = p.join(F.broadcast(tiles), TILE, "left")  # a row a tile: at most 64,800
    cy, cx = (F.col("lat") - F.col("tile_lat")) * (F.col("tile_size") - 1), (F.col("lon") - F.col("tile_lon")) * (F.col("tile_size") - 1)
    p = p.withColumns({"cy": cy, "cx": cx, "y": cy.cast("int"), "x": cx.cast("int")})
    rows = hgt_row.select(*TILE, "y", "h")
    if not keyed:
        asked = p.where("y is not null").select(*TILE, F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y"))
        rows = demanded(rows, asked, [*TILE, "y"]).groupBy(*TILE, "y").agg(F.max("h").alias("h"))
    at = lambda i: geo.void_to(F.get("h", F.col("x") + i), -1).cast("double")
    low = p.join(rows, [*TILE, "y"], "left").withColumns({"h00": at(0), "h01": at(1), "y": F.col("y") + 1}).drop("h")
    both = low.join(rows, [*TILE, "y"], "left").withColumns({"h10": at(0), "h11": at(1), "there": F.col("h").isNotNull()}).drop("h")
    h = geo.bilinear(*(F.col(c) for c in ("h00", "h01", "h10", "h11")), F.col("cx") - F.col("x"), F.col("cy") - (F.col("y") - 1))
    whole = F.when(F.col("there"), geo.truncated(h))
    return both.select(*points.columns, F.when(F.col("tile_size").isNull(), F.lit(0).cast("bigint")).otherwise(whole).alias("height"))


def sample_blocks(points: DataFrame, blocks: DataFrame, spacing: int, fmt: str = "4.1", keyed: bool = False) -> DataFrame:
    """points with h (double): bilinear in the grid block they fall in, north first; null where it isn't there.

    blocks: tile_lat, tile_lon, blocknum, grid_idx_x, grid_idx_y, heights (28 * 32). Of blocks of one place the last counts.
    Blocks that no point asks for are left out before heights move. keyed says that blocks is a table of write_keyed by
    BLOCK_KEYS, which is joined as it stands (see sample_hgt).
    """
    p = points.withColumns({"tile_lat": F.floor(F.col("lat_e7") * 1e-7).cast("int"), "tile_lon": F.floor(F.col("lon_e7") * 1e-7).cast("int")})
    off = geo.distance_ne(geo.corner_e7("tile_lat"), geo.corner_e7("tile_lon"), "lat_e7", "lon_e7", fmt)
    p = p.withColumn("off", off)
    p = p.withColumns({"ix": geo.truncated(F.col("off.north") / spacing), "iy": geo.truncated(F.col("off.east") / spacing)})
    p = p.withColumns({"grid_idx_x": F.floor(F.col("ix") / STEP_N), "grid_idx_y": F.floor(F.col("iy") / STEP_E)})
    p = p.withColumns({"lx": (F.col("ix") - F.col("grid_idx_x") * STEP_N).cast("int"), "ly": (F.col("iy") - F.col("grid_idx_y") * STEP_E).cast("int")})
    p = p.withColumns({"fx": (F.col("off.north") - F.col("ix") * spacing) / spacing, "fy": (F.col("off.east") - F.col("iy") * spacing) / spacing})
    place = [*TILE, "grid_idx_x", "grid_idx_y"]
    if keyed:  # keys in the table's types, or it would be shuffled for a cast
        p = p.withColumns({c: F.col(c).cast(blocks.schema[c].dataType) for c in place})
        one = blocks.select(*place, "heights")
    else:
        one = demanded(blocks, p, place).groupBy(*place).agg(F.max_by("heights", "blocknum").alias("heights"))
    j = p.join(one, place, "left")
    at = lambda a, b: F.get("heights", (F.col("lx") + a) * COLS + F.col("ly") + b).cast("double")
    west = (1 - F.col("fx")) * at(0, 0) + F.col("fx") * at(1, 0)
    east = (1 - F.col("fx")) * at(0, 1) + F.col("fx") * at(1, 1)
    inside = (F.col("lx") + 1 < ROWS) & (F.col("ly") + 1 < COLS)
    return j.select(*points.columns, F.when(inside, (1 - F.col("fy")) * west + F.col("fy") * east).alias("h"))


def compare_profiles(points: DataFrame, id_col: str, hgt_row: DataFrame, blocks: DataFrame, spacing: int, keyed: bool = False) -> DataFrame:
    """id, raster height, block height and their difference at the same points. keyed: both tables are (see sample_hgt); then
    a point is looked up in one after the other, so that nothing is joined by ids, and a stream of points works too."""
    if keyed:
        both = sample_blocks(sample_hgt(points, hgt_row, keyed=True), blocks, spacing, keyed=True)
        return both.select(id_col, F.col("height").alias("hgt_h"), F.col("h").alias("dat_h"), (F.col("h") - F.col("height")).alias("diff"))
    a = sample_hgt(points, hgt_row).select(id_col, F.col("height").alias("hgt_h"))
    b = sample_blocks(points, blocks, spacing).select(id_col, F.col("h").alias("dat_h"))
    return a.join(b, id_col, "full").withColumn("diff", F.col("dat_h") - F.col("hgt_h"))
