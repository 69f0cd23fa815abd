"""Checks of stores, steepness, and comparisons of two stores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sparkdem.functions.codec import crc16_xmodem, differing_bytes
from sparkdem.functions.geo import BLOCK_BYTES, COLS, DATA_BYTES, FULL_BITMAP, ROWS, STEP_E, STEP_N, VOID
from sparkdem.operators.grid import homes, mosaic, owned, resample_nearest

TILE = ["tile_lat", "tile_lon"]


def zero_mix(blocks: DataFrame, times: DataFrame | None = None, cutoff: str = "2026-01-12") -> DataFrame:
    """Per tile: zeros, heights in all, and whether it is affected: it holds both zeros and others. blocks: tile keys, heights.

    With times (tile keys and mtime, at most a row a degree), files written after the cutoff, or without a time, aren't affected.
    """
    zeros = F.size(F.filter("heights", lambda h: h == 0))
    out = blocks.groupBy(*TILE).agg(F.sum(zeros).alias("zeros"), F.sum(F.size("heights")).alias("total"))
    mixed = (F.col("zeros") > 0) & (F.col("zeros") < F.col("total"))
    if times is None:
        return out.withColumn("affected", mixed)
    old = F.coalesce(F.col("mtime") <= F.lit(cutoff).cast("timestamp"), F.lit(False))
    out = out.join(F.broadcast(times.groupBy(*TILE).agg(F.max("mtime").alias("mtime"))), TILE, "left")
    return out.withColumn("affected", mixed & old).drop("mtime")


def block_height_stats(blocks: DataFrame) -> DataFrame:
    positive = F.size(F.filter("heights", lambda h: h > 0))
    return blocks.groupBy(*TILE).agg(F.max(F.array_max("heights")).alias("max_h"), F.sum(positive).alias("positive"), F.sum(F.size("heights")).alias("total"))


def version_minor_audit(blocks: DataFrame) -> DataFrame:
    """Per tile: its distinct version_minor among valid blocks, and single, mixed, no valid blocks or, where blocks have
    file_bytes, bad file size (the last block may be as short as its data)."""
    odd = F.col("file_bytes") % BLOCK_BYTES if "file_bytes" in blocks.columns else F.lit(0)
    bad = F.bool_or(~F.coalesce(odd.isin(0, DATA_BYTES), F.lit(True))).alias("bad")
    out = blocks.groupBy(*TILE).agg(F.sort_array(F.collect_set(F.when(F.col("version") == 1, F.col("version_minor")))).alias("versions"), bad)
    state = F.when(F.col("bad"), "bad file size").when(F.size("versions") == 0, "no valid blocks").when(F.size("versions") == 1, "single").otherwise("mixed")
    return out.select(*TILE, F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"), state.alias("state"))


def check_blocks(blocks: DataFrame, spacing: int, with_crc: bool = False) -> DataFrame:
    """Adds reason: the first check that a block fails, or null. With with_crc, content (its bytes) is checked too."""
    c = F.col
    reason = (
        F.when((c("lat_e7") == 0) & (c("lon_e7") == 0) & (c("crc") == 0) & (c("version") == 0) & (c("spacing") == 0), "zero_header")
        .when(c("version") != 1, "version")
        .when((F.abs(c("tile_lat") - c("lat_e7") / 1e7) > 2) | (F.abs(c("tile_lon") - c("lon_e7") / 1e7) > 2), "position")
        .when(c("spacing") != spacing, "spacing")
        .when(c("bitmap") != FULL_BITMAP, "bitmap")
    )
    if with_crc:
        zeroed = F.concat(F.substring("content", 1, 16), F.lit(b"\0\0"), F.substring("content", 19, DATA_BYTES - 18))
        reason = F.when(F.octet_length("content") < DATA_BYTES, "size").otherwise(F.coalesce(reason, F.when(crc16_xmodem(zeroed) != c("crc"), "crc")))
    return blocks.withColumn("reason", reason)


def check_tiles(checked: DataFrame, spacing: int, min_blocks: int = 450, max_blocks: int = 6000) -> DataFrame:
    """Per tile: blocks, the first bad block and its reason, the extent of the blocks before it, and the count of errors.

    checked: check_blocks' rows. The rows before the first bad block are those whose running least bad number is beyond.
    Where they have file_bytes and error, as read_dat gives them, a file whose size fits no number of blocks is two errors
    (its size, and its count of no blocks; nothing else of it is checked), and one that can't be read is one. Empty files
    are no errors, as they hold nothing to be checked.
    """
    tile = Window.partitionBy(*TILE)
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("blocknum"))).over(tile)
    files = {"file_bytes", "error"} <= set(checked.columns)
    unread = F.col("error").isNotNull() if files else F.lit(False)
    bad_size = ~unread & ~(F.col("file_bytes") % BLOCK_BYTES).isin(0, DATA_BYTES) if files else F.lit(False)
    empty = ~unread & (F.col("file_bytes") == 0) if files else F.lit(False)
    rows = checked.select(*TILE, "blocknum", "lat_e7", "lon_e7", "reason", unread.alias("unread"), bad_size.alias("bad_size"), empty.alias("empty")).withColumn("first_bad", first)
    good = F.col("first_bad").isNull() | (F.col("blocknum") < F.col("first_bad"))
    extent = lambda c: F.coalesce((F.max(F.when(good, F.col(c))) - F.min(F.when(good, F.col(c)))) * 1e-7, F.lit(999.0))
    whole = F.when(F.coalesce(F.col("bad_size"), F.lit(False)), None).otherwise(F.col("blocknum"))
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("unread", "bad_size", "empty")]
    out = rows.groupBy(*TILE).agg(F.count(whole).alias("blocks"), F.max("first_bad").alias("first_bad"), F.max(F.when(F.col("blocknum") == F.col("first_bad"), F.col("reason"))).alias("reason"), extent("lat_e7").alias("lat_range"), extent("lon_e7").alias("lon_range"), *flags)
    scale = (9, 6000) if spacing == 30 else (1, 1)
    low = F.when(F.abs("tile_lat") >= 78, min(200, min_blocks)).otherwise(min_blocks) * scale[0]
    count_bad = ((F.col("blocks") < low) | (F.col("blocks") > max_blocks * scale[1])) & ~F.col("unread") & ~F.col("empty")
    wide = F.when(F.abs("tile_lat") > 60, 1.4).otherwise(1.08)
    looked_at = ~(F.col("unread") | F.col("bad_size") | F.col("empty"))
    range_bad = looked_at & (~F.col("lat_range").between(0.99, 1.01) | (F.col("lon_range") < 1.0) | (F.col("lon_range") > wide))
    first_bad, reason = (F.when(looked_at, F.col(c)).alias(c) for c in ("first_bad", "reason"))
    out = out.select(*TILE, "blocks", first_bad, reason, "unread", "bad_size", count_bad.alias("count_bad"), range_bad.alias("range_bad"))
    errors = sum((F.col(c).cast("int") for c in ("unread", "bad_size", "count_bad", "range_bad")), F.col("first_bad").isNotNull().cast("int"))
    kept = ["unread", "bad_size"] if files else []
    return out.select(*TILE, "blocks", "first_bad", "reason", *kept, "count_bad", "range_bad", errors.alias("errors"))


#: Raster rows that are worked through together at most.
STRIP_ROWS = 256
STRIP = "tile_lat int, tile_lon int, size int, n long, mh int, yh int, ch int, mv int, yv int, cv int"
HALO = "y int, h array<smallint>, lowest boolean, highest boolean"


def strips(hgt_row: DataFrame, threshold: int) -> DataFrame:
    """Two kinds of rows: what each strip of raster rows holds inside it (STRIP), and its outer rows (HALO).

    A strip is what stands together in a partition: rows of one tile whose y follow each other, either way. Files are read
    as whole rasters, so their strips are, too; of rows in no order each is a strip.
    """

    def inside(tile, size, ys, rows):
        """Statistics of rows from the south, the first of which may be the last of the strip before (counted there)."""
        h = np.array(rows, np.int32)
        void = h == VOID
        across = np.where(void[:, 1:] | void[:, :-1], -1, np.abs(np.diff(h, axis=1)))
        up = np.where(void[1:] | void[:-1], -1, np.abs(np.diff(h, axis=0)))
        return across, up

    def run(batches):
        tile, way, held = None, 0, []  # rows of the strip so far: (y, h), in the order of arrival
        size, fresh = None, True

        def flush(last: bool):
            """Statistics of what is held; the last row stays for the difference to the next one, unless the strip ends."""
            nonlocal held, fresh
            ordered = held if way >= 0 else held[::-1]
            across, up = inside(tile, size, *zip(*ordered))
            ys = np.array([y for y, _ in ordered])
            # a row that was held over has had its own differences counted
            own = np.ones(len(ys), bool)
            if not fresh:
                own[0 if way >= 0 else -1] = False
            mine = across[own]
            n = int((mine > threshold).sum() + (up > threshold).sum())
            found = [n]
            for d, y in ((mine, ys[own]), (up, ys[1:])):
                top = int(d.max(initial=-1))
                at = None
                if top >= 0:
                    r = np.flatnonzero(d.max(axis=1) == top)[-1]  # the northmost row, then the first column
                    at = (top, int(y[r]), int((d[r] == top).argmax()))
                found += at or (None, None, None)
            yield (*tile, size, *found), None
            if fresh:
                yield (*tile, size), (held[0][0], held[0][1], *((way >= 0, way < 0) if not last or len(held) > 1 else (True, True)))
            if last and (len(held) > 1 or not fresh):
                yield (*tile, size), (held[-1][0], held[-1][1], way < 0, way >= 0)
            held, fresh = ([] if last else held[-1:]), False

        def ended():
            if held and (fresh or len(held) > 1):
                yield from flush(True)
            elif held:
                yield (*tile, size), (held[0][0], held[0][1], way < 0, way >= 0)

        def rows_of(batch):
            cols = [batch.column(i).to_pylist() for i in range(4)]
            h = batch.column(4)
            for i, key in enumerate(zip(*cols)):
                yield key, h[i].values.to_numpy(zero_copy_only=False)

        def packed(items):
            out = list(items)
            cols = [[(s + (None,) * (10 - len(s)))[k] for s, _ in out] for k in range(10)]
            halo = [None if x is None else {"y": x[0], "h": x[1], "lowest": x[2], "highest": x[3]} for _, x in out]
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, arrow)), pa.array(halo, arrow[10].type)], schema=arrow)

        for batch in batches:
            out = []
            for (lat, lon, n, y), h in rows_of(batch):
                step = y - held[-1][0] if held else 0
                if held and tile == (lat, lon) and len(h) == len(held[-1][1]) and abs(step) == 1 and way in (0, step):
                    way = step
                    held.append((y, h))
                    if len(held) > STRIP_ROWS:
                        out += flush(False)
                else:
                    out += ended()
                    tile, size, way, held, fresh = (lat, lon), n, 0, [(y, h)], True
            yield packed(out)
        yield packed(ended())

    schema = _parse_datatype_string(f"{STRIP}, halo struct<{', '.join(c.replace(' ', ': ', 1) for c in HALO.split(', '))}>")
    arrow = to_arrow_schema(schema)
    there = hgt_row.where("y is not null and h is not null")
    return there.select("tile_lat", "tile_lon", F.col("size").cast("int").alias("size"), F.col("y").cast("int").alias("y"), F.col("h").cast("array<smallint>").alias("h")).mapInArrow(run, schema)


def steep_hgt(hgt_row: DataFrame, threshold: int) -> DataFrame:
    """Per tile: neighbour differences above the threshold, the largest one and where it is.

    Voids take no part. Horizontal differences win ties, then the first from the north-west. Rows are looked at where they
    stand (strips); only the outer rows of strips are shuffled, so that each meets the one to its south. Each raster row
    is there once. What stands together may differ each time that rows are shuffled, so strips are made once, and what is
    inside them and their outer rows go through one shuffle.
    """
    clean = lambda c: F.transform(c, lambda v: F.when(v != VOID, v.cast("int")))
    # a row of statistics has no y; an outer row goes to its own y, to the next one to the north, or to both
    found = strips(hgt_row, threshold).withColumn("to", F.expr("if(halo is null, array(null), filter(array(if(halo.lowest, halo.y, null), if(halo.highest, halo.y + 1, null)), y -> y is not null))"))
    sent = found.withColumn("y", F.explode("to")).withColumns({"h": F.when(F.col("y") == F.col("halo.y"), F.col("halo.h")), "south": F.when(F.col("y") == F.col("halo.y") + 1, F.col("halo.h"))})
    best = lambda m, y, c: F.max_by(F.struct(F.col(y).alias("y"), F.col(c).alias("c")), F.when(F.col(m).isNotNull(), F.struct(m, y)))
    level = [F.max("size").alias("size"), F.sum("n").alias("n"), F.max("mh").alias("mh"), F.max("mv").alias("mv"), best("mh", "yh", "ch").alias("ph"), best("mv", "yv", "cv").alias("pv")]
    met = sent.groupBy(*TILE, "y").agg(*level, F.max("h").alias("h"), F.max("south").alias("south"))
    met = met.withColumn("dv", F.zip_with(clean("h"), clean("south"), lambda a, b: F.abs(a - b))).withColumn("most", F.array_max("dv"))
    steep = F.size(F.filter(F.coalesce("dv", F.array().cast("array<int>")), lambda d: d > threshold)).cast("long")
    place = F.struct("y", (F.array_position("dv", F.col("most")) - 1).cast("int").alias("c"))
    met = met.withColumns({"n": F.coalesce("n", F.lit(0)) + steep, "mv": F.coalesce("mv", "most"), "pv": F.coalesce("pv", F.when(F.col("most").isNotNull(), place))})
    last = lambda m, p: F.max_by(p, F.when(F.col(m).isNotNull(), F.struct(F.col(m), F.col(f"{p}.y")))).alias(p)
    out = met.groupBy(*TILE).agg(F.max("size").alias("size"), F.sum("n").alias("steep"), F.max("mh").alias("mh"), F.max("mv").alias("mv"), last("mh", "ph"), last("mv", "pv"))
    horizontal = (F.coalesce("mh", F.lit(0)) >= F.coalesce("mv", F.lit(0))) & (F.coalesce("mh", F.lit(0)) > 0)
    vertical = F.coalesce("mv", F.lit(0)) > 0
    row = F.when(horizontal, F.col("size") - 1 - F.col("ph.y")).when(vertical, F.col("size") - 1 - F.col("pv.y")).otherwise(0)
    col = F.when(horizontal, F.col("ph.c")).when(vertical, F.col("pv.c")).otherwise(0)
    return out.select(*TILE, "steep", F.greatest("mh", "mv").alias("max_diff"), (F.col("tile_lat") + 1.0 - row / (F.col("size") - 1)).alias("max_lat"), (F.col("tile_lon") + col / (F.col("size") - 1)).alias("max_lon"))


def steep_blocks(blocks: DataFrame, threshold: int) -> DataFrame:
    """Per tile the same inside each block; blocks: tile keys, blocknum, heights and, for the position, lat_e7, lon_e7 and spacing.

    Blocks of version and spacing zero, where blocks have these columns, are empty and take no part; a tile of such ones only
    has no steep neighbours. A tile without any difference has a largest one of 0, and no block and place of it.
    Positions are display approximations: 111,111 m to the degree of latitude.
    """
    has = set(blocks.columns)
    if {"version", "spacing"} <= has:
        blocks = blocks.withColumn("heights", F.when((F.col("version") != 0) | (F.col("spacing") != 0), F.col("heights")))
    dh = F.expr(f"transform(filter(sequence(0, {ROWS * COLS - 1}), i -> i % {COLS} < {COLS - 1}), i -> abs(int(heights[i + 1]) - int(heights[i])))")
    dv = F.expr(f"transform(sequence(0, {(ROWS - 1) * COLS - 1}), i -> abs(int(heights[i + {COLS}]) - int(heights[i])))")
    corner = [c for c in ("lat_e7", "lon_e7", "spacing") if c in has]
    each = blocks.select(*TILE, "blocknum", *corner, dh.alias("dh"), dv.alias("dv"))
    n = F.size(F.filter("dh", lambda d: d > threshold)) + F.size(F.filter("dv", lambda d: d > threshold))
    each = each.select(*TILE, "blocknum", *corner, F.greatest(F.lit(0), n).alias("n"), F.array_max("dh").alias("mh"), F.array_max("dv").alias("mv"), (F.array_position("dh", F.array_max("dh")) - 1).alias("ih"), (F.array_position("dv", F.array_max("dv")) - 1).alias("iv"))
    level = F.col("mh") >= F.col("mv")
    gx, gy = F.when(level, F.floor(F.col("ih") / (COLS - 1))).otherwise(F.floor(F.col("iv") / COLS)), F.when(level, F.col("ih") % (COLS - 1)).otherwise(F.col("iv") % COLS)
    each = each.select(*TILE, "n", F.greatest("mh", "mv").alias("m"), F.col("blocknum"), gx.alias("gx"), gy.alias("gy"), *corner)
    # the first block of the largest difference, if that is any
    best = F.max_by(F.struct("blocknum", "gx", "gy", *corner), F.when(F.col("m") > 0, F.struct(F.col("m"), -F.col("blocknum"))))
    out = each.groupBy(*TILE).agg(F.sum("n").alias("steep"), F.coalesce(F.max("m"), F.lit(0)).alias("max_diff"), best.alias("b"))
    at = []
    if len(corner) == 3:
        lat = F.col("b.lat_e7") * 1e-7
        east = 111111.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
        at = [(lat + F.col("b.gx") * F.col("b.spacing") / 111111.0).alias("max_lat"), (F.col("b.lon_e7") * 1e-7 + F.col("b.gy") * F.col("b.spacing") / east).alias("max_lon")]
    return out.select(*TILE, "steep", "max_diff", "b.blocknum", F.col("b.gx").alias("gx"), F.col("b.gy").alias("gy"), *at)


def steep_report(results: DataFrame, top: int | None = None) -> DataFrame:
    """Tiles with steep neighbours, the steepest first, then by key."""
    out = results.where("steep > 0").orderBy(F.desc("max_diff"), *TILE)
    return out.limit(top) if top else out


def steep_summary(results: DataFrame) -> DataFrame:
    """One row: tiles looked at, those with steep neighbours, and, where results have error, those that couldn't be read."""
    error = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    return results.agg(F.count("*").alias("tiles"), F.count_if((F.col("steep") > 0) & ~error).alias("steep"), F.count_if(error).alias("errors"))


def unread(results: DataFrame) -> DataFrame:
    """The results that couldn't be read, in order, apart from the report."""
    return results.where("error is not null").orderBy(*TILE)


def status_summary(results: DataFrame, status_col: str) -> DataFrame:
    return results.groupBy(F.col(status_col).alias("status")).agg(F.count("*").alias("n"))


def compare_stores(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """Names in both stores whose bytes differ, with how many."""
    pairs = a.select(key, F.col(content).alias("a")).join(b.select(key, F.col(content).alias("b")), key).where(~F.col("a").eqNullSafe(F.col("b")))
    return pairs.select(key, differing_bytes("a", "b").alias("differing"))


def common_names(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each name of two stores once, and side: both, first or second, where it is."""
    mark = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    side = F.bit_or("s")
    return mark.groupBy(key).agg(F.when(side == 3, "both").when(side == 1, "first").otherwise("second").alias("side"))


def store_summary(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """One row: names in both stores (compared), and those whose bytes differ (differ)."""
    pairs = a.select(key, F.col(content).alias("a")).join(b.select(key, F.col(content).alias("b")), key)
    return pairs.agg(F.count("*").alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))


def resume_blocks(work: DataFrame, stored: DataFrame, spacing: int, with_crc: bool = True) -> DataFrame:
    """The blocks of work (tile keys, blocknum, lat_e7, lon_e7) of which the store holds no valid one: one that passes all
    checks (with that of its bytes in content, unless with_crc is false) and whose corner lies within two units of latitude
    and of longitude of where it should be."""
    good = check_blocks(stored, spacing, with_crc).where("reason is null")
    good = good.select(*TILE, "blocknum", F.col("lat_e7").alias("at_lat"), F.col("lon_e7").alias("at_lon"))
    same = [work[c] == good[c] for c in (*TILE, "blocknum")]
    near = [F.abs(work[c] - good[at]) <= 2 for c, at in (("lat_e7", "at_lat"), ("lon_e7", "at_lon"))]
    return work.join(good, [*same, *near], "left_anti")


def height_changes(old: DataFrame, new: DataFrame, layout: tuple[int, int] = (32, 28)) -> DataFrame:
    """Per tile what changed between two stores (tile, blocknum, heights): points, changed, from zero to positive, the
    largest such height, and the height and flat index that show it best: a point whose four neighbours were zero, if any.

    Only blocks that differ are exploded. Blocks of unequal length aren't compared (null counts for their tile).
    """
    cols = layout[1]
    j = old.select(*TILE, "blocknum", F.col("heights").alias("a")).join(new.select(*TILE, "blocknum", F.col("heights").alias("b")), [*TILE, "blocknum"])
    j = j.withColumn("equal", F.size("a") == F.size("b"))
    totals = j.groupBy(*TILE).agg(F.sum(F.size("a")).alias("points"), F.bool_and("equal").alias("fits"))
    cells = j.where("equal and a <> b").select(*TILE, "blocknum", "a", F.posexplode("b").alias("i", "new")).withColumn("was", F.get("a", F.col("i")))
    cells = cells.where("new <> was").withColumns({"gx": F.floor(F.col("i") / cols).cast("int"), "gy": F.col("i") % cols})
    inner = (F.col("gx") >= 1) & (F.col("gx") < layout[0] - 1) & (F.col("gy") >= 1) & (F.col("gy") < layout[1] - 1)
    zero = lambda d: F.coalesce(F.get("a", F.col("i") + d) == 0, F.lit(True))
    alone = inner & zero(-cols) & zero(cols) & zero(-1) & zero(1)
    cells = cells.withColumns({"fixed": (F.col("was") == 0) & (F.col("new") > 0), "alone": alone, "idx": F.col("blocknum") * (layout[0] * layout[1]) + F.col("i")})
    best = lambda cond: F.max(F.when(cond, F.struct(F.col("new").alias("h"), (-F.col("idx")).alias("neg"))))
    got = cells.groupBy(*TILE).agg(F.count("*").alias("changed"), F.sum(F.col("fixed").cast("int")).alias("zero_to_positive"), best(F.col("fixed")).alias("any"), best(F.col("fixed") & F.col("alone")).alias("lone"))
    out = totals.join(got, TILE, "left").withColumn("shown", F.coalesce("lone", "any"))
    zero0 = lambda c: F.when(F.col("fits"), F.coalesce(c, F.lit(0)))
    return out.select(*TILE, "points", zero0(F.col("changed")).alias("changed"), zero0(F.col("zero_to_positive")).alias("zero_to_positive"), zero0(F.col("any.h").cast("int")).alias("max_altitude"), zero0(F.col("shown.h").cast("int")).alias("report_altitude"), zero0(-F.col("shown.neg")).alias("report_idx"))


def diff_mosaics(a: DataFrame, b: DataFrame, spacing_a: float = 1, spacing_b: float = 1) -> DataFrame:
    """row, col, diff of two mosaics (tile, row, col, h); a cell that one lacks counts as zero there. Of two spacings the
    coarser mosaic is resampled to the finer one's cells first."""
    if spacing_a > spacing_b:
        a = resample_nearest(a, spacing_a, spacing_b)
    elif spacing_b > spacing_a:
        b = resample_nearest(b, spacing_b, spacing_a)
    j = a.withColumnRenamed("h", "ha").join(b.withColumnRenamed("h", "hb"), [*TILE, "row", "col"], "full")
    return j.select(*TILE, "row", "col", (F.coalesce("ha", F.lit(0)).cast("int") - F.coalesce("hb", F.lit(0)).cast("int")).alias("diff"))


def diff_blocks(a: DataFrame, b: DataFrame, spacing_a: float = 1, spacing_b: float = 1) -> DataFrame:
    """row, col, diff of two stores of blocks (tile, grid_idx_x, grid_idx_y, blocknum, heights), as diff_mosaics gives them of
    their mosaics. At one spacing blocks are joined as arrays, and cells appear only where nothing is shuffled any more."""
    if spacing_a != spacing_b:
        return diff_mosaics(mosaic(a), mosaic(b), spacing_a, spacing_b)
    place = [*TILE, "home_x", "home_y"]
    both = homes(a, "a").join(homes(b, "b"), place, "full")
    k = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEP_N * STEP_E - 1))).alias("k"))
    r, c = F.floor(F.col("k") / STEP_E).cast("int"), F.col("k") % STEP_E
    row, col = F.col("home_x") * STEP_N + r, F.col("home_y") * STEP_E + c
    cells = k.select(*TILE, row.alias("row"), col.alias("col"), owned("a", r, c).alias("a"), owned("b", r, c).alias("b"))
    cells = cells.where("a is not null or b is not null")
    return cells.select(*TILE, "row", "col", (F.coalesce("a", F.lit(0)).cast("int") - F.coalesce("b", F.lit(0)).cast("int")).alias("diff"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Per tile: cells, those that differ, and the least and the largest difference."""
    return diffs.groupBy(*TILE).agg(F.count_if(F.col("diff") != 0).alias("changed"), F.min("diff").alias("least"), F.max("diff").alias("most"), F.count("*").alias("cells"))


def abs_diff_percentile(diffs: DataFrame, q: float = 0.98) -> DataFrame:
    """Exact, linear, over the differences that aren't zero; heights are integers, so few distinct values are held."""
    return diffs.groupBy(*TILE).agg(F.percentile(F.when(F.col("diff") != 0, F.abs("diff")), q).alias("p"), F.max(F.abs("diff")).alias("most"))


def altitude_rgb(cells: DataFrame, grey: bool = False) -> DataFrame:
    """Adds red, green, blue of each cell's height between its tile's least and largest non-zero height."""
    # a row a tile: at most 64,800; so the cells are neither sorted nor shuffled
    out = cells.join(F.broadcast(tile_altitude_range(cells)), TILE)
    t = ((F.col("h") - F.col("lo")).cast("float") / (F.col("hi") - F.col("lo")).cast("float")).cast("float").cast("double")
    warm = (F.lit(255.0) * t).cast("float").cast("int")
    flat = F.col("hi") == F.col("lo")
    red = F.when(F.col("h") == 0, 0).when(flat, 128).otherwise(warm)
    blue = F.when(F.col("h") == 0, 0).when(flat, 128).otherwise(warm if grey else (F.lit(255.0) * (1 - t).cast("float")).cast("float").cast("int"))
    green = F.when((F.col("h") == 0) | F.lit(not grey), 0).when(flat, 128).otherwise(warm)
    return out.select(*cells.columns, red.alias("red"), green.alias("green"), blue.alias("blue"))


def diff_rgb(diffs: DataFrame) -> DataFrame:
    """Adds red (more) and blue (less) of each difference, against the 98th percentile of its tile."""
    scale = abs_diff_percentile(diffs)
    out = diffs.join(F.broadcast(scale), TILE)  # a row a tile: at most 64,800
    by = F.coalesce(F.when(F.col("p") > 0, F.col("p")), F.col("most")).cast("double")
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("diff") / by))
    level = lambda r: F.when(F.col("diff") == 0, 0).otherwise((F.greatest(F.lit(0.0), r) * 255).cast("int"))
    return out.select(*diffs.columns, level(ratio).alias("red"), level(-ratio).alias("blue"))


def tile_altitude_range(cells: DataFrame) -> DataFrame:
    seen = F.when(F.col("h") != 0, F.col("h"))
    return cells.groupBy(*TILE).agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
