"""Rows beside other rows of their tile: differences to neighbours, first and last ones, and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdem.functions.geo import VOID

TILE = ["tile_lat", "tile_lon"]


def neighbour_differences(pixels: DataFrame) -> DataFrame:
    """dx, dy of each pixel (tile, x, y, h) that isn't void: its height less that of the pixel before it in its row, and in its
    column; null for the first. Voids are passed over."""
    across, up = Window.partitionBy(*TILE, "y").orderBy("x"), Window.partitionBy(*TILE, "x").orderBy("y")
    h = F.col("h").cast("int")
    return pixels.where(F.col("h") != VOID).select(*TILE, "x", "y", (h - F.lag(h).over(across)).alias("dx"), (h - F.lag(h).over(up)).alias("dy"))


def first_of_the_largest(pixels: DataFrame, order: Column) -> DataFrame:
    """Per tile the largest h, and x and y of the pixel that has it, of several the first in order. No sort: an aggregation."""
    best = F.max_by(F.struct("x", "y"), F.struct("h", -order))
    return pixels.groupBy(*TILE).agg(best.alias("b"), F.max("h").cast("int").alias("h")).select(*TILE, "h", "b.x", "b.y")


def before_first_bad(checked: DataFrame) -> DataFrame:
    """The blocks (tile, blocknum, reason) before the first of their tile that has a reason; all where none has."""
    first = checked.where("reason is not null").groupBy(*TILE).agg(F.min("blocknum").alias("first_bad"))
    rows = checked.join(F.broadcast(first), TILE, "left")  # a row a tile: at most 64,800
    return rows.where("first_bad is null or blocknum < first_bad").drop("first_bad")


def last_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one place the one of the largest order (which ties don't share). No sort: an aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def beside_bounds(pixels: DataFrame) -> DataFrame:
    """How far each pixel's height lies above the least and below the largest one of its tile; null for voids. Bounds are a row a
    tile, at most 64,800, that are broadcast, so pixels are neither sorted nor shuffled."""
    rows = pixels.withColumn("height", F.when(F.col("h") != VOID, F.col("h").cast("int")))
    bounds = rows.groupBy(*TILE).agg(F.min("height").alias("least"), F.max("height").alias("most"))
    return rows.join(F.broadcast(bounds), TILE).select(*TILE, "x", "y", (F.col("height") - F.col("least")).alias("above_least"), (F.col("most") - F.col("height")).alias("below_most"))
