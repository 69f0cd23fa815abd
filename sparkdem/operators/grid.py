"""Tiles, grid blocks and their points: planning, enumeration, generation, resampling and mosaics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdem.functions import geo
from sparkdem.functions.codec import encode_blocks, interpolate_tile
from sparkdem.functions.geo import COLS, E7_PER_M, FULL_BITMAP, ROWS, STEP_E, STEP_N

TILE = ["tile_lat", "tile_lon"]
#: From the step of blocks to their length, north and east.
STEP = {STEP_N: ROWS, STEP_E: COLS}


def world_tiles(spark: SparkSession, lat_min: int, lat_max: int) -> DataFrame:
    """All keys of the latitudes lat_min..lat_max, both included."""
    lats = spark.range(lat_min, lat_max + 1).select(F.col("id").cast("int").alias("tile_lat"))
    return lats.withColumn("tile_lon", F.explode(F.sequence(F.lit(-180), F.lit(179))))


def classify_tiles(tiles: DataFrame, catalogue: DataFrame, min_len: int = 14_500) -> DataFrame:
    """kind: land, ocean (not in a complete catalogue) or unknown. The catalogue has at most one row a degree: 64,800."""
    known = F.broadcast(catalogue.select(*TILE).distinct().withColumn("known", F.lit(True)))
    size = F.broadcast(catalogue.select(*TILE).distinct().agg((F.count("*") > min_len).alias("complete")))
    kind = F.when(F.col("known"), "land").when(F.col("complete"), "ocean").otherwise("unknown")
    return tiles.join(known, TILE, "left").join(size).select(*tiles.columns, kind.alias("kind"))


def pending(work: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    return work if overwrite else work.join(F.broadcast(done.select(*TILE).distinct()), TILE, "left_anti")  # at most 64,800 keys


def planned_tiles(spark: SparkSession, mode: str, lat_min: int, lat_max: int, existing: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """The distinct tiles that a run plans: the whole world of the latitudes, those that exist in a store, or a given list."""
    if mode == "world":
        return world_tiles(spark, lat_min, lat_max)
    chosen = {"existing": existing, "list": listed}.get(mode)
    if chosen is None:
        raise ValueError("a plan is world, or existing or list with their tiles")
    return chosen.select(*TILE).distinct()


def consumers(tiles: DataFrame) -> DataFrame:
    """The up to four tiles whose blocks read each tile: itself, and those to the west, south and south-west."""
    moves = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, -1) for b in (0, -1)))
    out = tiles.withColumn("m", F.explode(moves))
    return out.select(*tiles.columns, (F.col("tile_lat") + F.col("m.a")).alias("for_lat"), (F.col("tile_lon") + F.col("m.b")).alias("for_lon"))


def reach_north(spacing: int) -> float:
    """Degrees beyond its own that a tile's blocks read to the north, at most."""
    return (ROWS + STEP_N) * spacing * E7_PER_M * 1e-7


def reach_east(lat: Column, spacing: int) -> Column:
    """Degrees beyond its own that the blocks of a tile of that latitude read to the east, at most: rows of blocks are as long as
    the degree at its south side and two blocks more, and are stretched where it is shorter."""
    scale = lambda c: F.greatest(F.cos(F.radians(c)), F.lit(0.01))
    # a cosine is least at an end of a range, but where all of it counts as 0.01
    narrow = F.least(scale(lat - 1.0), scale(lat + 1.0 + math.ceil(reach_north(spacing))))
    return (scale(lat) + 3 * COLS * spacing * E7_PER_M * 1e-7) / narrow - 1


def readers(tiles: DataFrame, spacing: int) -> DataFrame:
    """The tiles (for_lat, for_lon) whose blocks at a spacing read each tile: those up to `north` degrees to the south and `east`
    degrees to the west, itself included; columns of tiles stay."""
    south = tiles.withColumn("north", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(reach_north(spacing))))))
    south = south.withColumn("for_lat", F.col("tile_lat") - F.col("north"))
    west = south.withColumn("east", F.explode(F.sequence(F.lit(0), F.ceil(reach_east(F.col("for_lat"), spacing)).cast("int"))))
    return west.withColumn("for_lon", F.col("tile_lon") - F.col("east"))


def read_by(tiles: DataFrame, spacing: int) -> DataFrame:
    """The tiles that the blocks of some tiles read at a spacing, those included, each once."""
    out = tiles.select(*TILE).withColumn("east", F.explode(F.sequence(F.lit(0), F.ceil(reach_east(F.col("tile_lat"), spacing)).cast("int"))))
    out = out.withColumn("north", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(reach_north(spacing))))))
    return out.select((F.col("tile_lat") + F.col("north")).alias("tile_lat"), (F.col("tile_lon") + F.col("east")).alias("tile_lon")).distinct()


def enumerate_blocks(tiles: DataFrame, spacing: int, fmt: str = "4.1") -> DataFrame:
    """Blocks of each tile in row-major order, as far as they begin within the degree and map back to their number."""
    rows = math.ceil(1e7 / (STEP_N * spacing * E7_PER_M)) + 1
    lat0, lon0 = geo.corner_e7("tile_lat"), geo.corner_e7("tile_lon")
    out = tiles.withColumn("stride", geo.east_blocks(lat0, lon0, F.lit(spacing), fmt))
    out = out.withColumn("grid_idx_x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows).cast("bigint"))))
    out = out.where(geo.add_offset(lat0, lon0, F.col("grid_idx_x") * (STEP_N * spacing), F.lit(0), fmt)["lat_e7"] * 1e-7 - F.col("tile_lat") < 1.0)
    out = out.withColumn("grid_idx_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stride") - 1)))
    at = geo.add_offset(lat0, lon0, F.col("grid_idx_x") * (STEP_N * spacing), F.col("grid_idx_y") * (STEP_E * spacing), fmt)
    out = out.withColumn("at", at).withColumn("off", geo.distance_ne(lat0, lon0, F.col("at.lat_e7"), F.col("at.lon_e7"), fmt))
    back = lambda c, step: F.floor(geo.truncated(F.rint(F.col(c)) / spacing) / step)
    num = F.col("stride") * F.col("grid_idx_x") + F.col("grid_idx_y")
    fits = F.col("stride") * back("off.north", STEP_N) + back("off.east", STEP_E) == num
    return out.where(fits).select(*tiles.columns, num.alias("blocknum"), "grid_idx_x", "grid_idx_y", "at.lat_e7", "at.lon_e7")


def grid_points(blocks: DataFrame, spacing: int) -> DataFrame:
    """The 28 * 32 points of each block, each one step from the tile's corner."""
    out = blocks.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(COLS - 1))))
    north, east = (F.col("grid_idx_x") * STEP_N + F.col("gx")) * spacing, (F.col("grid_idx_y") * STEP_E + F.col("gy")) * spacing
    p = geo.add_offset(geo.corner_e7("tile_lat"), geo.corner_e7("tile_lon"), north, east)
    return out.withColumn("p", p).select(*TILE, "blocknum", "gx", "gy", "p.lat_e7", "p.lon_e7")


def generate_blocks(hgt_row: DataFrame, tiles: DataFrame, spacing: int, on_bad_tile: str = "ocean") -> DataFrame:
    """Blocks with heights of each tile of `tiles`, from raster rows (tile_lat, tile_lon, size, y, h).

    The one large shuffle sends each raster row to the tiles that read it (readers): its own tile takes all rows, the tiles to the
    south only those within reach of their last block, and the tiles to the west only the columns within reach. A group
    is one tile and the strips beside it. A raster that couldn't be read (a row with a null y) is ocean, or with "skip" its
    tile isn't generated.
    """
    if on_bad_tile not in ("ocean", "skip"):
        raise ValueError("a bad tile is ocean, or skipped")
    if on_bad_tile == "skip":
        tiles = pending(tiles, hgt_row.where("y is null and tile_lat is not null"))
    rows = readers(hgt_row.where("y is not null").select(*TILE, "size", "y", "h"), spacing)
    rows = rows.where((F.col("north") == 0) | (F.col("y") <= F.ceil((reach_north(spacing) - F.col("north") + 1) * (F.col("size") - 1)) + 1))
    wanted = tiles.select(F.col("tile_lat").alias("for_lat"), F.col("tile_lon").alias("for_lon")).distinct()
    rows = rows.join(F.broadcast(wanted), ["for_lat", "for_lon"], "left_semi")  # at most 64,800 keys
    east = F.ceil((reach_east(F.col("for_lat"), spacing) - F.col("east") + 1) * (F.col("size") - 1)).cast("int") + 2
    rows = rows.withColumn("h", F.when(F.col("east") == 0, F.col("h")).otherwise(F.slice("h", F.lit(1), F.least(F.col("size"), east)))).drop("north", "east")
    blocks = enumerate_blocks(tiles.select(*TILE), spacing).groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("blocknum", "grid_idx_x", "grid_idx_y", "lat_e7", "lon_e7"))).alias("blocks"))
    a = rows.withColumnsRenamed({"tile_lat": "src_lat", "tile_lon": "src_lon"}).groupBy("for_lat", "for_lon")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in right.itertuples(index=False):
            rasters = {}
            for key, part in left.groupby(["src_lat", "src_lon"]):
                size = int(part["size"].iloc[0])
                full = np.full((int(part["y"].max()) + 1, size), geo.VOID, np.int16)
                for y, h in zip(part["y"], part["h"]):
                    full[y, : len(h)] = h
                rasters[(int(key[0]), int(key[1]))] = full
            b = pd.DataFrame([{k: x[k] for k in ("blocknum", "grid_idx_x", "grid_idx_y", "lat_e7", "lon_e7")} for x in r.blocks])
            heights = interpolate_tile(rasters, int(r.tile_lat), int(r.tile_lon), b["grid_idx_x"].to_numpy(), b["grid_idx_y"].to_numpy(), spacing)
            out.append(b.assign(tile_lat=r.tile_lat, tile_lon=r.tile_lon, spacing=spacing, heights=list(heights)))
        cols = ["tile_lat", "tile_lon", "spacing", "blocknum", "grid_idx_x", "grid_idx_y", "lat_e7", "lon_e7", "heights"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    schema = "tile_lat int, tile_lon int, spacing int, blocknum long, grid_idx_x long, grid_idx_y long, lat_e7 long, lon_e7 long, heights array<smallint>"
    return a.cogroup(blocks.groupBy(*TILE)).applyInPandas(run, schema)


def generate_ocean(tiles: DataFrame, catalogue: DataFrame, spacing: int) -> DataFrame:
    """All-zero blocks of the tiles that aren't in the catalogue."""
    blocks = enumerate_blocks(pending(tiles, catalogue), spacing)
    return blocks.select(*TILE, F.lit(spacing).alias("spacing"), "blocknum", "grid_idx_x", "grid_idx_y", "lat_e7", "lon_e7", F.array_repeat(F.lit(0).cast("smallint"), ROWS * COLS).alias("heights"))


def with_header(blocks: DataFrame, version_minor: int = 1) -> DataFrame:
    """The header's fields of generated blocks, ready to be stored."""
    return blocks.select(
        F.lit(FULL_BITMAP).alias("bitmap"), "lat_e7", "lon_e7", F.lit(1).alias("version"), "spacing", "heights", "grid_idx_x", "grid_idx_y",
        F.col("tile_lon").alias("lon_degrees"), F.col("tile_lat").alias("lat_degrees"), F.lit(version_minor).alias("version_minor"), "blocknum",
    )


def pack_blocks(blocks: DataFrame) -> DataFrame:
    """Adds content: the 2048 stored bytes of each block."""

    def run(batches):
        for b in batches:
            yield b.assign(content=encode_blocks(b))

    return blocks.mapInPandas(run, T.StructType([*blocks.schema.fields, T.StructField("content", T.BinaryType())]))


def set_version_minor(blocks: DataFrame, value: int) -> DataFrame:
    """version_minor of valid blocks; the checksum doesn't cover it."""
    if not 0 <= value <= 255:
        raise ValueError("version_minor is a byte")
    return blocks.withColumn("version_minor", F.when(F.col("version") == 1, value).otherwise(F.col("version_minor")).cast("smallint"))


def decimate(hgt_row: DataFrame, step: int = 3) -> DataFrame:
    """Every step-th pixel both ways, counted from the north row and the west column."""
    kept = hgt_row.where((F.col("size") - 1 - F.col("y")) % step == 0)
    h = F.expr(f"transform(sequence(0, (size - 1) div {step}), i -> h[i * {step}])")
    y = (((F.col("size") - 1) / step).cast("int") - ((F.col("size") - 1 - F.col("y")) / step).cast("int")).cast("int")
    return kept.select(*TILE, (((F.col("size") - 1) / step).cast("int") + 1).alias("size"), y.alias("y"), h.alias("h"))


def decimate_status(hgt_row: DataFrame, size: int = 3601) -> DataFrame:
    """Per tile: ok, or why it isn't decimated."""
    sizes = hgt_row.groupBy(*TILE).agg(F.max("size").alias("n"))
    return sizes.select(*TILE, F.when(F.col("n") == size, "ok").otherwise(F.concat(F.lit("not SRTM1 (size="), F.coalesce(F.col("n").cast("string"), F.lit("unknown")), F.lit(")"))).alias("status"))


#: A cubic spline through the pixels, read at the pixels that stay, gives those pixels.
resample_cubic = decimate


def mean_pool(pixels: DataFrame, step: int = 3) -> DataFrame:
    """The mean, truncated, of the step * step pixels around each pixel that decimation keeps; voids don't count."""
    half = step // 2
    row, col = F.floor((F.col("size") - 1 - F.col("y") + half) / step), F.floor((F.col("x") + half) / step)
    valid = pixels.where(F.col("h") != geo.VOID).withColumns({"row": row, "col": col})
    return valid.groupBy(*TILE, "row", "col").agg(geo.truncated(F.avg("h")).alias("h"))


def mosaic(cells: DataFrame) -> DataFrame:
    """row, col, h from block heights (tile, grid_idx_x, grid_idx_y, blocknum, heights); overlaps go to the last block.

    Only the four rows and columns at a block's sides are another block's, too. So each block learns the last numbers
    around it from a shuffle of keys, and drops what isn't its own inside its array: no cell is shuffled.
    """
    place = [*TILE, "grid_idx_x", "grid_idx_y"]
    last = cells.groupBy(*place).agg(F.max("blocknum").alias("last"))
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    sent = last.select(*TILE, "last", "grid_idx_x", "grid_idx_y", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))).alias("s"))
    # what lies at (a, b) from a block is sent to it by that one
    sent = sent.select(*TILE, (F.col("grid_idx_x") - F.col("s.a")).alias("grid_idx_x"), (F.col("grid_idx_y") - F.col("s.b")).alias("grid_idx_y"), "s", F.struct(F.col("last").alias("num"), F.col("grid_idx_x").alias("at_x"), F.col("grid_idx_y").alias("at_y")).alias("n"))
    around = sent.groupBy(*place).agg(*(F.max(F.when((F.col("s.a") == a) & (F.col("s.b") == b), F.col("n"))).alias(f"n{i}") for i, (a, b) in enumerate(steps)))
    one = cells.groupBy(*place).agg(F.max_by("heights", "blocknum").alias("heights"), F.max("blocknum").alias("blocknum"))
    out = one.join(around, place).select(*place, F.struct(F.col("blocknum").alias("num"), F.col("grid_idx_x").alias("at_x"), F.col("grid_idx_y").alias("at_y")).alias("own"), *(f"n{i}" for i in range(9)), F.posexplode("heights").alias("i", "h"))
    r, c = F.floor(F.col("i") / COLS), F.col("i") % COLS
    over = {-1: lambda x, step: x < STEP[step] - step, 0: lambda x, step: F.lit(True), 1: lambda x, step: x >= step}
    mine = F.lit(True)
    for i, (a, b) in enumerate(steps):
        if a or b:
            covers = over[a](r, STEP_N) & over[b](c, STEP_E)
            mine = mine & ~(covers & F.coalesce(F.col(f"n{i}") > F.col("own"), F.lit(False)))
    return out.where(mine).select(*TILE, (F.col("grid_idx_x") * STEP_N + r).alias("row"), (F.col("grid_idx_y") * STEP_E + c).alias("col"), "h")


def homes(blocks: DataFrame, name: str) -> DataFrame:
    """tile, home_x, home_y and a struct of that name: everything that a store holds of each place of STEP_N * STEP_E cells.

    A block covers its own place, and with its last rows and columns a part of the three places to the north and east. Each
    part goes there as an array with its block's number: own, from the south, from the west, and from the south-west.
    Blocks are shuffled once, as arrays, by place. Of blocks of one place the last counts.
    """
    kinds = ["own", "south", "west", "corner"]
    side = lambda rows: f"flatten(transform(sequence({rows}), r -> slice(heights, r * {COLS} + {STEP_E + 1}, {COLS - STEP_E})))"
    parts = ["heights", f"slice(heights, {STEP_N * COLS + 1}, {(ROWS - STEP_N) * COLS})", side(f"0, {STEP_N - 1}"), side(f"{STEP_N}, {ROWS - 1}")]
    moves = [(0, 0), (1, 0), (0, 1), (1, 1)]
    sent = F.expr("inline(array(" + ", ".join(f"struct({x} as x, {y} as y, {k} as kind, {p} as v)" for k, ((x, y), p) in enumerate(zip(moves, parts))) + "))")
    sent = blocks.select(*TILE, "grid_idx_x", "grid_idx_y", "blocknum", sent)
    place = [(F.col("grid_idx_x") + F.col("x")).cast("long").alias("home_x"), (F.col("grid_idx_y") + F.col("y")).cast("long").alias("home_y")]
    last = [F.max_by(F.struct(F.col("blocknum").alias("num"), "v"), F.when(F.col("kind") == k, F.col("blocknum"))).alias(kind) for k, kind in enumerate(kinds)]
    return sent.groupBy(*TILE, *place).agg(*last).select(*TILE, "home_x", "home_y", F.struct(*kinds).alias(name))


def owned(name: str, r: Column, c: Column) -> Column:
    """The height at row r and column c of a place, from a struct of homes: of the blocks that cover it the one of the largest
    number, of equal numbers the northmost, then the eastmost; null if none does."""
    south, west = r < ROWS - STEP_N, c < COLS - STEP_E
    of = lambda kind: F.col(f"{name}.{kind}.v")
    number = lambda kind: F.coalesce(F.col(f"{name}.{kind}.num"), F.lit(-1).cast("long"))
    none = F.lit(-1).cast("long")
    found = {
        "own": (number("own"), F.get(of("own"), r * COLS + c)),
        "west": (F.when(west, number("west")).otherwise(none), F.get(of("west"), r * (COLS - STEP_E) + c)),
        "south": (F.when(south, number("south")).otherwise(none), F.get(of("south"), r * COLS + c)),
        "corner": (F.when(south & west, number("corner")).otherwise(none), F.get(of("corner"), r * (COLS - STEP_E) + c)),
    }
    most = F.greatest(*(n for n, _ in found.values()))
    out = F.when(most == -1, None)
    for n, v in found.values():
        out = out.when(n == most, v)
    return out


def resample_nearest(cells: DataFrame, old: float, new: float) -> DataFrame:
    """Cells (tile, row, col, h) at another spacing: each new cell takes the old one its index falls in.

    The target indices of an old cell are a range, so this is an explode and needs no join.
    """
    scale = old / new
    dims = cells.groupBy(*TILE).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    limit = lambda c: geo.truncated((F.col(c) + 1) * scale)

    def targets(c: str, most: str):
        wide = F.sequence(F.greatest(F.lit(0).cast("bigint"), geo.truncated(F.col(c) * scale) - 1), geo.truncated((F.col(c) + 1) * scale) + 1)
        return F.filter(wide, lambda i: (F.least(geo.truncated(i / scale), F.col(most).cast("bigint")) == F.col(c)) & (i < limit(most)))

    out = cells.join(F.broadcast(dims), TILE)  # a row a tile: at most 64,800
    out = out.withColumn("r", F.explode(targets("row", "rows"))).withColumn("c", F.explode(targets("col", "cols")))
    return out.select(*TILE, F.col("r").alias("row"), F.col("c").alias("col"), "h")


def profile_points(tiles: DataFrame, percent: float, step_m: float) -> DataFrame:
    """Points along a parallel at so many hundredths of each tile, from its west side, so many metres apart."""
    lat = F.col("tile_lat") + percent / 100.0
    step = step_m / (111320.0 * F.cos(F.radians(lat)))
    out = tiles.select(*TILE, lat.alias("lat"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.floor(1 / step).cast("int") + 1)).alias("k"))
    return out.where(F.col("k") * F.col("step") < 1.0).select(*TILE, "k", "lat", (F.col("tile_lon") + F.col("k") * F.col("step")).alias("lon"))
