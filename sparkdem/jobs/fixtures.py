"""The driver's tables as terrain: rasters, points, blocks, catalogues and requests derived from them by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdem.functions.geo import VOID
from sparkdem.functions.names import tile_name

SIZE = 25


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    return _read(spark, sf_dir, "orders").selectExpr(
        f"cast({k} div 3750 as int) as tile_lat", f"cast({k} div 625 % 6 as int) as tile_lon", f"{SIZE} as size", f"cast({k} % 25 as int) as x",
        f"cast({k} % 625 div 25 as int) as y", f"cast(case when {k} % 97 = 0 then {VOID} else cast(o_totalprice / 100 as bigint) end as smallint) as h",
    )


def hgt_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).groupBy("tile_lat", "tile_lon", "size", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "h"))).alias("m"))
    h = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(VOID).cast("smallint")))
    return rows.select("tile_lat", "tile_lon", "size", "y", h.alias("h"))


def full_raster(spark: SparkSession, sf_dir: str, size: int = 1201) -> DataFrame:
    """The rasters at a size that files have: each pixel repeated, rows that aren't there void. Tiles are dealt while they are small,
    so that what works by tile shuffles no full rows."""
    step = (size - 1) // (SIZE - 1)
    tiles = hgt_row(spark, sf_dir).groupBy("tile_lat", "tile_lon").agg(F.map_from_entries(F.collect_list(F.struct("y", "h"))).alias("m"))
    tiles = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile_lat", "tile_lon")
    absent = F.array_repeat(F.lit(VOID).cast("smallint"), SIZE)
    every = tiles.select("tile_lat", "tile_lon", "m", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("k"))
    small = every.select("tile_lat", "tile_lon", "k", F.coalesce(F.try_element_at("m", F.col("k")), absent).alias("h"))
    # each row is widened once, and then repeated; parts of a row that are alike are made by native functions
    last = size - 1 - step * (SIZE - 1)
    wide = F.flatten(F.transform("h", lambda v: F.array_repeat(v, step)))
    wide = F.concat(F.slice(wide, 1, step * (SIZE - 1)), F.array_repeat(F.element_at("h", SIZE), last + 1))
    up = F.explode(F.expr(f"sequence(k * {step}, least(k * {step} + {step - 1}, {size - 1}))"))
    return small.select("tile_lat", "tile_lon", "k", wide.alias("h")).select("tile_lat", "tile_lon", up.alias("y"), "h")


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks with the fields of a header, numbered within their tiles."""
    return blocks(spark, sf_dir).selectExpr(
        "tile_lat", "tile_lon", "int(blocknum % 4) as blocknum", "72057594037927935 as bitmap", "tile_lat * 10000000L + blocknum % 4 as lat_e7", "blocknum % 4 * 2000 as lon_e7", "1 as version", "100 as spacing",
        "heights", "int(grid_idx_x) as grid_idx_x", "int(grid_idx_y) as grid_idx_y", "tile_lon as lon_degrees", "tile_lat as lat_degrees", "1 as version_minor",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id as point_id", "event_id * 7919 % 40000000 as lat_e7", "event_id * 104729 % 60000000 as lon_e7")


def points_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id as point_id", "event_id * 7919 * 104729 % 1680000001 - 840000000 as lat_e7", "event_id * 15485863 % 3600000000 - 1800000000 as lon_e7")


def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, block, place and the old and new height of each."""
    k = "o_orderkey"
    old = f"case when {k} % 3 = 0 then 0 else cast(o_totalprice / 100 as bigint) end"
    return _read(spark, sf_dir, "orders").selectExpr(
        f"cast({k} div 3584 as int) as tile_lat", "0 as tile_lon", f"cast({k} div 896 as bigint) as blocknum", f"cast({k} % 896 as int) as i",
        f"cast({old} as smallint) as old", f"cast(case when {k} % 7 = 0 then cast(o_totalprice / 50 as bigint) else {old} end as smallint) as new",
    )


def blocks(spark: SparkSession, sf_dir: str, which: str = "old") -> DataFrame:
    """Blocks of heights; the four blocks of a tile lie two by two. Heights that a partial last block lacks are 0."""
    got = block_cells(spark, sf_dir).groupBy("tile_lat", "tile_lon", "blocknum").agg(F.array_sort(F.collect_list(F.struct("i", F.col(which).alias("h")))).alias("s"))
    # a whole block's heights are in order already; only a partial one is searched for what it lacks
    absent = "transform(sequence(0, 895), k -> coalesce(try_element_at(map_from_entries(s), k), smallint(0)))"
    heights = F.expr(f"if(size(s) = 896 and s[0].i = 0 and s[895].i = 895, transform(s, x -> x.h), {absent})")
    return got.select("tile_lat", "tile_lon", "blocknum", F.expr("blocknum % 4 div 2").alias("grid_idx_x"), F.expr("blocknum % 2").alias("grid_idx_y"), heights.alias("heights"))


def block_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    return _read(spark, sf_dir, "part").selectExpr(
        f"cast({k} div 100 as int) as tile_lat", "7 as tile_lon", f"cast({k} % 100 as int) as blocknum",
        f"case when {k} % 89 = 5 then 0 when {k} % 61 = 7 then ({k} div 100 + 3) * 10000000 else ({k} div 100) * 10000000 + ({k} % 100) * 100000 end as lat_e7",
        f"case when {k} % 89 = 5 then 0 else 70000000 + ({k} % 100) * 102000 end as lon_e7", f"case when {k} % 89 = 5 then 0 else 1 end as crc",
        f"case when {k} % 89 = 5 then 0 when {k} % 83 = 3 then 2 else 1 end as version", f"case when {k} % 89 = 5 then 0 when {k} % 79 = 3 then 30 else 100 end as spacing",
        f"case when {k} % 73 = 3 then 1 else 72057594037927935 end as bitmap", "cast(p_size % 2 as smallint) as version_minor",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey % 120 - 60 as tile_lat", "p_partkey * 7 % 360 - 180 as tile_lon", "p_partkey as k")
    regions = F.broadcast(_read(spark, sf_dir, "region").selectExpr("r_regionkey as r", "r_name"))  # five rows
    named = part.join(regions, F.col("k") % 5 == F.col("r")).withColumn("continent", F.expr("case when k % 41 = 0 then '' when k % 43 = 0 then 'USGS' else r_name end"))
    return named.select(F.col("tile_lat").cast("int"), F.col("tile_lon").cast("int"), "continent", tile_name(F.col("tile_lat"), F.col("tile_lon"), ".hgt.zip").alias("filename"), "k")


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalogue(spark, sf_dir)
    return f.select("k", F.expr("case k % 6 when 0 then filename when 1 then lower(filename) when 2 then replace(filename, '.zip', '') when 3 then concat(filename, '.bak') when 4 then substr(filename, 1, 7) else concat('x', filename) end").alias("name"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return _read(spark, sf_dir, "customer").selectExpr(
        f"{k} as request_id", f"case when {k} % 11 = 0 then 'bad' else cast(({k} * 7919 * 104729 % 1680000001 - 840000000) / 1e7 as string) end as lat",
        f"cast(({k} * 15485863 % 3600000000 - 1800000000) / 1e7 as string) as lon", f"cast(1 + {k} % 5 as string) as radius", f"cast(case when {k} % 13 = 0 then 2 when {k} % 2 = 0 then 1 else 3 end as string) as version",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.expr("case o_orderstatus when 'O' then 'ok' when 'F' then 'skipped' else 'error' end").alias("status"))
