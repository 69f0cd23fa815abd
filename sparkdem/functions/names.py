"""Names of tiles: N00E006 and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How strictly a name is read, by where names come from.
STYLES = {
    "hgt_zip": r"^([NS])(\d{2})([EW])(\d{3})\.hgt\.zip$",
    "hgt_zip_prefix": r"^([NS])(\d{2})([EW])(\d{3})\.hgt\.zip",
    "hgt": r"(?i)^([NS])(\d{2})([EW])(\d{3})\.hgt(?:\.zip)?$",
    "search": r"([NS])(\d{2})([EW])(\d{3})",
    "prefix": r"^([NS])(\d{2})([EW])(\d{3})",
    "list": r"(?i)^([NS])(\d{2})([EW])(\d{3})",
}
# names of files that tile_name made, which has a digit more for latitudes from 100 on
STYLES |= {f"stored_{s}": STYLES[s].replace(r"\d{2}", r"\d{2,9}") for s in ("hgt_zip", "hgt", "prefix")}


def parse_tile_name(c: Column, style: str = "prefix") -> Column:
    """Struct tile_lat, tile_lon of the south-west corner; null where the name doesn't fit the style."""
    part = lambda i: F.regexp_extract(c, STYLES[style], i)
    signed = lambda n, letter, negative: F.when(F.upper(letter) == negative, -n).otherwise(n)
    lat, lon = (F.when(part(i) != "", part(i)).cast("int") for i in (2, 4))
    return F.when(part(1) != "", F.struct(signed(lat, part(1), "S").alias("tile_lat"), signed(lon, part(3), "W").alias("tile_lon")))


def tile_name(lat: Column, lon: Column, ext: str = "") -> Column:
    """The name of each tile; latitudes of three digits or more, which no place has, are written whole, so that no two tiles share one."""
    return F.format_string(
        f"%s%02d%s%03d{ext}",
        F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lat).cast("int"),
        F.when(lon >= 0, "E").otherwise("W"),
        F.least(F.abs(lon).cast("int"), F.lit(999)),
    )
