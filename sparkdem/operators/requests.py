"""Requests for areas: validation, the tiles they cover, and whether these can be served."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdem.functions import geo

#: Latitudes that the store covers, metres of a step of the lattice, and the largest radius in kilometres.
MOST_LAT, STEP_M, MOST_RADIUS = 84, 1000, 400


def validate_requests(df: DataFrame) -> DataFrame:
    """Typed columns, spacing, and status: ok, or an error. lat, lon, radius and version may be texts."""
    lat, lon = (F.col(c).cast("string").try_cast("double") for c in ("lat", "lon"))
    radius, version = (F.col(c).cast("string").try_cast("int") for c in ("radius", "version"))
    fine = lat.isNotNull() & lon.isNotNull() & radius.isNotNull() & (lat > -90) & (lat < 90) & (lon > -180) & (lon < 180) & version.isin(1, 3)
    return df.select(
        "request_id", lat.alias("lat"), lon.alias("lon"), F.greatest(F.lit(1), F.least(F.lit(MOST_RADIUS), radius)).alias("radius"), version.alias("version"),
        F.when(version == 1, 30).when(version == 3, 100).alias("spacing"), F.when(F.coalesce(fine, F.lit(False)), "ok").otherwise("Error with input").alias("status"),
    )


def cover_expr() -> F.Column:
    """The distinct tiles of the lattice of steps around lat, lon, radius: per step north, the range of longitudes that
    the steps east span (they are less than a degree apart, so it has no gaps)."""
    lat, lon = F.col("lat") * 1e7, F.col("lon") * 1e7

    def row(dx):
        at = lambda dy: geo.add_offset(lat, lon, dx * STEP_M, dy * STEP_M)
        west, east = at(-F.col("radius")), at(F.col("radius") - 1)
        low, high = F.floor(west["lon_e7"] * 1e-7).cast("int"), F.floor(east["lon_e7"] * 1e-7).cast("int")
        return F.transform(F.sequence(low, high), lambda t: F.struct(F.floor(west["lat_e7"] * 1e-7).cast("int").alias("tile_lat"), t.alias("tile_lon")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(-F.col("radius"), F.col("radius") - 1), row)))


def cover_requests(requests: DataFrame) -> DataFrame:
    """request_id, tile_lat, tile_lon, outside: a row for each tile of each valid request, distinct inside the row, so
    nothing is shuffled; it holds on a stream as well."""
    tiles = requests.where("status = 'ok'").select("request_id", F.explode(cover_expr()).alias("t"))
    return tiles.select("request_id", "t.tile_lat", "t.tile_lon", (F.abs("t.tile_lat") > MOST_LAT).alias("outside"))


def resolve_requests(cover: DataFrame, store: DataFrame) -> DataFrame:
    """Per request: its tiles, those outside, and ok or why it can't be served. A request whose tiles all lie outside is ok
    and has none. store has at most one row a degree."""
    have = F.broadcast(store.select("tile_lat", "tile_lon").distinct().withColumn("have", F.lit(True)))
    j = cover.join(have, ["tile_lat", "tile_lon"], "left").withColumn("served", F.col("outside") | F.coalesce("have", F.lit(False)))
    out = j.groupBy("request_id").agg(F.count_if(~F.col("outside")).alias("tiles"), F.count_if("outside").alias("outside"), F.bool_and("served").alias("all"))
    return out.select("request_id", "tiles", "outside", F.when(F.col("all"), "ok").otherwise("Cannot generate terrain").alias("status"))


def distinct_tiles(cover: DataFrame) -> DataFrame:
    return cover.groupBy("tile_lat", "tile_lon").agg(F.min("request_id").alias("first_request"))


def tiles_by_continent(catalogue: DataFrame) -> DataFrame:
    """continent and its members, sorted, each once (so at most as many as there are tiles); names without a continent and the survey's own folder are left out."""
    member = F.concat(F.regexp_replace("filename", r"\.hgt\.zip$", ""), F.lit(".DAT.gz"))
    used = catalogue.where("continent not in ('', 'USGS')")
    return used.groupBy("continent").agg(F.sort_array(F.collect_set(member)).alias("members"))
