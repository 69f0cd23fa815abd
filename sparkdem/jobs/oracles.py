"""SQL (DuckDB) that gives the rows of the queries from the same tables, written from the operators' definitions."""

from __future__ import annotations

K, M = "89.83204650878906::double", "0.011131884530186653::double"


def scale(lat: str) -> str:
    return f"greatest(cast(cast(cos(cast(cast(radians({lat}) as float) as double)) as float) as double), 0.01::double)"


def t(x: str) -> str:
    return f"cast(trunc({x}) as bigint)"


def fl(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def dlat(north: str) -> str:
    return t(f"({north})::double * {K}")


def lat_at(lat: str, north: str) -> str:
    return t(f"({lat})::double + {dlat(north)}")


def lon_at(lat: str, lon: str, north: str, east: str, old: bool = False) -> str:
    mid = f"({lat})::double * 1.0e-7::double" if old else f"(({lat})::double + {dlat(north)} * 0.5::double) * 1.0e-7::double"
    return t(f"({lon})::double + {t(f'({east})::double * {K} / {scale(mid)}')}")


def wrap(a: str, b: str) -> str:
    d = f"(({a}) - ({b}))"
    return f"(case when sign({a}) * sign({b}) >= 0 then {d} when {d} > 1800000000 then {d} - 3600000000 when {d} < -1800000000 then {d} + 3600000000 else {d} end)"


def north(lat1: str, lat2: str) -> str:
    return f"(({lat2}) - ({lat1})) * {M}"


def east(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"{wrap(lon2, lon1)} * {scale(f'(({lat1}) + ({lat2})) * 0.5::double * 1.0e-7::double')} * {M}"


def stride(lat: str, lon: str, spacing: int) -> str:
    end = lon_at(lat, f"{lon} + 10000000", "0", str(2 * spacing * 32))
    return t(f"{east(lat, lon, lat, end)} / {spacing * 28}")


VOID = -32768
ORD = "orders"
VIEWS = {
    "pixels": f"select cast(o_orderkey // 3750 as int) tile_lat, cast(o_orderkey // 625 % 6 as int) tile_lon, 25 size, cast(o_orderkey % 25 as int) x, cast(o_orderkey % 625 // 25 as int) y, case when o_orderkey % 97 = 0 then {VOID} else cast(trunc(o_totalprice / 100) as int) end h from orders",
    # a raster row that is there is whole: absent pixels are void
    "raster": f"select r.tile_lat, r.tile_lon, r.y, g.x, coalesce(p.h, {VOID}) h from (select distinct tile_lat, tile_lon, y from pixels) r cross join (select cast(range as int) x from range(25)) g left join pixels p on p.tile_lat = r.tile_lat and p.tile_lon = r.tile_lon and p.y = r.y and p.x = g.x",
    "points": "select event_id point_id, event_id * 7919 % 40000000 lat_e7, event_id * 104729 % 60000000 lon_e7 from events",
    "points_world": "select event_id point_id, event_id * 7919 * 104729 % 1680000001 - 840000000 lat_e7, event_id * 15485863 % 3600000000 - 1800000000 lon_e7 from events",
    "stored": "select cast(o_orderkey // 3584 as int) tile_lat, 0 tile_lon, o_orderkey // 896 blocknum, cast(o_orderkey % 896 as int) i, case when o_orderkey % 3 = 0 then 0 else cast(trunc(o_totalprice / 100) as int) end as old, case when o_orderkey % 7 = 0 then cast(trunc(o_totalprice / 50) as int) when o_orderkey % 3 = 0 then 0 else cast(trunc(o_totalprice / 100) as int) end as new from orders",
    # a block that is there is whole: absent heights are 0
    "cells": "select b.tile_lat, b.tile_lon, b.blocknum, g.i, coalesce(s.old, 0) as old, coalesce(s.new, 0) as new from (select distinct tile_lat, tile_lon, blocknum from stored) b cross join (select cast(range as int) i from range(896)) g left join stored s on s.blocknum = b.blocknum and s.i = g.i",
    "mosaic": "select tile_lat, tile_lon, (blocknum % 4 // 2) * 24 + i // 32 as row, (blocknum % 2) * 28 + i % 32 as col, arg_max(old, blocknum) h, arg_max(new, blocknum) hn from cells group by all",
    "headers": "select cast(k // 100 as int) tile_lat, 7 tile_lon, cast(k % 100 as int) blocknum, case when z then 0 when k % 61 = 7 then (k // 100 + 3) * 10000000 else (k // 100) * 10000000 + (k % 100) * 100000 end lat_e7, case when z then 0 else 70000000 + (k % 100) * 102000 end lon_e7, case when z then 0 else 1 end crc, case when z then 0 when k % 83 = 3 then 2 else 1 end as version, case when z then 0 when k % 79 = 3 then 30 else 100 end spacing, case when k % 73 = 3 then 1 else 72057594037927935 end as bitmap, cast(p_size % 2 as smallint) version_minor from (select p_partkey k, p_partkey % 89 = 5 z, p_size from part)",
    "checked": "select *, case when lat_e7 = 0 and lon_e7 = 0 and crc = 0 and version = 0 and spacing = 0 then 'zero_header' when version <> 1 then 'version' when abs(tile_lat - lat_e7 / 1e7::double) > 2 or abs(tile_lon - lon_e7 / 1e7::double) > 2 then 'position' when spacing <> 100 then 'spacing' when bitmap <> 72057594037927935 then 'bitmap' end reason from headers",
    "catalogue": "select cast(p_partkey % 120 - 60 as int) tile_lat, cast(p_partkey * 7 % 360 - 180 as int) tile_lon, case when p_partkey % 41 = 0 then '' when p_partkey % 43 = 0 then 'USGS' else r_name end continent, printf('%s%02d%s%03d.hgt.zip', case when p_partkey % 120 - 60 >= 0 then 'N' else 'S' end, abs(p_partkey % 120 - 60), case when p_partkey * 7 % 360 - 180 >= 0 then 'E' else 'W' end, abs(p_partkey * 7 % 360 - 180)) filename, p_partkey k from part join region on p_partkey % 5 = r_regionkey",
    "tile_names": "select k, case k % 6 when 0 then filename when 1 then lower(filename) when 2 then replace(filename, '.zip', '') when 3 then filename || '.bak' when 4 then substr(filename, 1, 7) else 'x' || filename end as name from catalogue",
    "requests": "select c_custkey request_id, case when c_custkey % 11 = 0 then null else (c_custkey * 7919 * 104729 % 1680000001 - 840000000) / 1e7::double end lat, (c_custkey * 15485863 % 3600000000 - 1800000000) / 1e7::double lon, cast(1 + c_custkey % 5 as int) radius, case when c_custkey % 13 = 0 then 2 when c_custkey % 2 = 0 then 1 else 3 end as version from customer",
    "cover": f"select distinct request_id, {fl('a * 1e-7::double')}::int tile_lat, {fl('o * 1e-7::double')}::int tile_lon from (select request_id, {lat_at('lat * 1e7::double', 'dx * 1000')} a, {lon_at('lat * 1e7::double', 'lon * 1e7::double', 'dx * 1000', 'dy * 1000')} o from (select r.*, gx.range dx, gy.range dy from requests r join range(-5, 5) gx on gx.range >= -radius and gx.range < radius join range(-5, 5) gy on gy.range >= -radius and gy.range < radius where lat is not null and lon > -180 and version <> 2))",
    "world": "select cast(a.range as int) tile_lat, cast(b.range as int) tile_lon from range(-85, 85) a, range(-180, 180) b",
    "land": "select distinct tile_lat, tile_lon from catalogue",
}
NEEDS = {"raster": ["pixels"], "cells": ["stored"], "mosaic": ["stored", "cells"], "checked": ["headers"], "tile_names": ["catalogue"], "cover": ["requests"], "land": ["catalogue"]}


def sql(body: str, *views: str, **more: str) -> str:
    order: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    parts = [f"{v} as ({VIEWS[v]})" for v in order] + [f"{k} as ({x})" for k, x in more.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def sampled(points: str, extra: str = "") -> dict[str, str]:
    """Views that end in `sampled`: point_id and height of `points` in the raster."""
    v = lambda a: f"case when {a}.h = {VOID} then -1 else {a}.h end::double"
    south, up = f"({v('b')} * fx + {v('a')} * (1 - fx))", f"({v('d')} * fx + {v('c')} * (1 - fx))"
    on = lambda a, dx, dy: f"left join raster {a} on {a}.tile_lat = p.tile_lat and {a}.tile_lon = p.tile_lon and {a}.x = p.x + {dx} and {a}.y = p.y + {dy}"
    return {
        "placed": f"select *, cast(trunc(cx) as int) x, cast(trunc(cy) as int) y, cx - trunc(cx) fx, cy - trunc(cy) fy from (select *, (lat - tile_lat) * 24 cy, (lon - tile_lon) * 24 cx from (select *, lat_e7 * 1e-7::double lat, lon_e7 * 1e-7::double lon, cast(floor(lat_e7 * 1e-7::double) as int) tile_lat, cast(floor(lon_e7 * 1e-7::double) as int) tile_lon from {points}))",
        "there": "select distinct tile_lat, tile_lon from pixels",
        "sampled": f"select p.point_id, p.tile_lat, p.tile_lon{extra}, case when there.tile_lat is null then 0 when c.h is not null and a.h is not null then {t(f'{up} * fy + {south} * (1 - fy)')} end height from placed p left join there using (tile_lat, tile_lon) {on('a', 0, 0)} {on('b', 1, 0)} {on('c', 0, 1)} {on('d', 1, 1)}",
    }


def in_blocks(points: str) -> dict[str, str]:
    """Views that end in `read`: point_id and h of `points` in the old blocks."""
    on = lambda a, dx, dy: f"left join cells {a} on {a}.tile_lat = p.tile_lat and p.tile_lon = 0 and p.gx between 0 and 1 and p.gy between 0 and 1 and {a}.blocknum = p.tile_lat * 4 + p.gx * 2 + p.gy and {a}.i = (p.lx + {dx}) * 32 + p.ly + {dy}"
    return {
        "offs": f"select *, {north('tile_lat * 10000000', 'lat_e7')} n, {east('tile_lat * 10000000', 'tile_lon * 10000000', 'lat_e7', 'lon_e7')} e from (select *, cast(floor(lat_e7 * 1e-7::double) as int) tile_lat, cast(floor(lon_e7 * 1e-7::double) as int) tile_lon from {points})",
        "spots": "select *, ix - gx * 24 lx, iy - gy * 28 ly, (n - ix * 100) / 100 fx, (e - iy * 100) / 100 fy from (select *, cast(floor(ix / 24) as bigint) gx, cast(floor(iy / 28) as bigint) gy from (select *, cast(trunc(n / 100) as bigint) ix, cast(trunc(e / 100) as bigint) iy from offs))",
        "read": f"select p.point_id, (1 - fy) * ((1 - fx) * a.old + fx * b.old) + fy * ((1 - fx) * c.old + fx * d.old) h from spots p {on('a', 0, 0)} {on('b', 1, 0)} {on('c', 0, 1)} {on('d', 1, 1)}",
    }


def block_views(tiles: str, spacing: int, north_reach: int) -> dict[str, str]:
    """Views that end in `blocks`, by the definition; north_reach: rows enough to pass a degree."""
    at_n, at_e = f"gx * {24 * spacing}", f"gy * {28 * spacing}"
    back = lambda x, step: fl(f"trunc(round_even({x}, 0) / {spacing}) / {step}")
    return {
        "strides": f"select *, tile_lat * 10000000 la, tile_lon * 10000000 lo, {stride('tile_lat * 10000000', 'tile_lon * 10000000', spacing)} stride from {tiles}",
        "spread": f"select s.*, a.range gx, b.range gy from strides s join range({north_reach}) a on true join range(2000) b on b.range < stride",
        "placed_blocks": f"select *, stride * gx + gy blocknum, {lat_at('la', at_n)} lat_e7, {lon_at('la', 'lo', at_n, at_e)} lon_e7 from spread",
        "blocks": f"select tile_lat, tile_lon, blocknum, gx grid_idx_x, gy grid_idx_y, lat_e7, lon_e7 from placed_blocks where lat_e7 * 1e-7::double - tile_lat < 1.0 and stride * {back(north('la', 'lat_e7'), 24)} + {back(east('la', 'lo', 'lat_e7', 'lon_e7'), 28)} = blocknum",
    }


def point_views(spacing: int) -> dict[str, str]:
    return {
        "grid_pts": f"select b.tile_lat bl, b.tile_lon bo, blocknum, b.lat_e7 block_lat, b.lon_e7 block_lon, x.range px, y.range py, {lat_at('b.tile_lat * 10000000', f'(grid_idx_x * 24 + x.range) * {spacing}')} lat_e7, {lon_at('b.tile_lat * 10000000', 'b.tile_lon * 10000000', f'(grid_idx_x * 24 + x.range) * {spacing}', f'(grid_idx_y * 28 + y.range) * {spacing}')} lon_e7 from blocks b, range(28) x, range(32) y"
    }


def name_parts(style: str, label: str) -> str:
    flag = ", 'i'" if style.startswith("(?i)") else ""
    rx = style.replace("(?i)", "")
    part = lambda i: f"regexp_extract(name, '{rx}', {i}{flag})"
    one = lambda i, neg: f"case when {part(1)} <> '' then cast({part(i + 1)} as int) * case when upper({part(i)}) = '{neg}' then -1 else 1 end end"
    return f"{one(1, 'S')} {label}_lat, {one(3, 'W')} {label}_lon"


TILE = r"([NS])(\d{2})([EW])(\d{3})"
STYLES = {"hgt_zip": rf"^{TILE}\.hgt\.zip$", "hgt_zip_prefix": rf"^{TILE}\.hgt\.zip", "hgt": rf"(?i)^{TILE}\.hgt(?:\.zip)?$", "search": TILE, "prefix": f"^{TILE}", "list": f"(?i)^{TILE}"}
G4 = block_views("(select distinct tile_lat, tile_lon from pixels)", 1000, 8) | point_views(1000)
# the bulk reader takes a raster as far as its rows go, and clips at its edges
CLIP = {
    "spots4": "select *, least(cast(floor(cx) as int), 23) x, least(cast(floor(cy) as int), 23) y, cx - floor(cx) fx, cy - floor(cy) fy from (select g.*, tile_lat, tile_lon, last_y, (lat_e7 * 1e-7::double - tile_lat) * 24 cy, (lon_e7 * 1e-7::double - tile_lon) * 24 cx from (select *, cast(floor(lat_e7 * 1e-7::double) as int) tl, cast(floor(lon_e7 * 1e-7::double) as int) tn from grid_pts) g left join (select tile_lat, tile_lon, max(y) last_y from pixels group by all) m on m.tile_lat = tl and m.tile_lon = tn)"
}


def heights4(tile_filter: str = "true") -> dict[str, str]:
    v = lambda a: f"case when {a}.h = {VOID} then -1 else {a}.h end::double"
    on = lambda a, dx, y: f"left join raster {a} on {a}.tile_lat = p.tile_lat and {a}.tile_lon = p.tile_lon and {a}.x = p.x + {dx} and {a}.y = least({y}, last_y)"
    val = f"({v('d')} * fx + {v('c')} * (1 - fx)) * fy + ({v('b')} * fx + {v('a')} * (1 - fx)) * (1 - fy)"
    return CLIP | {"heights": f"select bl tile_lat, bo tile_lon, blocknum, block_lat, block_lon, case when p.tile_lat is null then 0 else {t(val)} end h from spots4 p {on('a', 0, 'p.y')} {on('b', 1, 'p.y')} {on('c', 0, 'p.y + 1')} {on('d', 1, 'p.y + 1')} where {tile_filter}"}


SUMMARY = "select tile_lat, tile_lon, blocknum, block_lat lat_e7, block_lon lon_e7, cast(sum(h) as bigint) sum_h, cast(min(h) as int) min_h, cast(max(h) as int) max_h from heights group by all"
PCT = "select tile_lat, quantile_cont(case when hn <> h then abs(hn - h) end, 0.98) p, max(abs(hn - h)) most from mosaic group by all"
F4 = "cast(255 * cast(cast(h - lo as float) / cast(hi - lo as float) as float)::double as float)"
HREF = r"""<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""".replace("'", "''")
ORACLES = {
    "A11_flagship_sampled_heights": sql("select tile_lat, tile_lon, max(height) max_h, cast(sum(case when height > 0 then 1 when height is not null then 0 end) as bigint) positive, count(*) total from sampled group by all", "raster", "points", **sampled("points")),
    "J3_sample_hgt": sql("select point_id, height from sampled", "raster", "points", **sampled("points")),
    "P1_parse_tile_name": sql(f"select k, {', '.join(name_parts(r, s) for s, r in STYLES.items())} from tile_names", "tile_names"),
    "P2_tile_name": sql("select point_id, printf('%s%02d%s%03d.DAT', case when a >= 0 then 'N' else 'S' end, abs(a), case when o >= 0 then 'E' else 'W' end, abs(o)) as name from (select point_id, cast(floor(lat_e7 * 1e-7::double) as int) a, cast(floor(lon_e7 * 1e-7::double) as int) o from points_world)", "points_world"),
    "P3_longitude_scale": sql(f"select point_id, {scale('lat_e7 * 1e-7::double')} as scale from points_world", "points_world"),
    "P4_diff_longitude": sql(f"select point_id, {wrap('lon_e7', '(5 - lon_e7)')} d from points_world", "points_world"),
    "P5_distance_ne": sql(f"select point_id, round({north('lat_e7', 'lat_e7 + 12345')}, 6) north, round({east('lat_e7', 'lon_e7', 'lat_e7 + 12345', '(-lon_e7)')}, 3) east, round((-lon_e7 - lon_e7) * {M} * {scale('lat_e7 * 1.0e-7::double')}, 3) east_old from points_world", "points_world"),
    "P6_add_offset": sql(f"select point_id, {lat_at('lat_e7', 'point_id % 50000')} lat_e7, {lon_at('lat_e7', 'lon_e7', 'point_id % 50000', 'point_id % 7919')} lon_e7, {lon_at('lat_e7', 'lon_e7', 'point_id % 50000', 'point_id % 7919', True)} lon_old from points_world", "points_world"),
    "P7_east_blocks": sql(f"select tile_lat, tile_lon, {stride('tile_lat * 10000000', 'tile_lon * 10000000', 30)} stride_30, {stride('tile_lat * 10000000', 'tile_lon * 10000000', 100)} stride_100 from land", "land"),
    "P8_block_origin": sql(f"select tile_lat, tile_lon, n, {lat_at('la', 'gx * 2400')} lat_e7, {lon_at('la', 'lo', 'gx * 2400', 'gy * 2800')} lon_e7 from (select *, n // stride gx, n % stride gy from (select *, tile_lat * 10000000 la, tile_lon * 10000000 lo, {stride('tile_lat * 10000000', 'tile_lon * 10000000', 100)} stride from land, (values (0), (41), (777)) v(n)))", "land"),
    "P9_block_of_point": sql(f"select point_id, gx grid_idx_x, gy grid_idx_y, ix - gx * 24 local_x, iy - gy * 28 local_y, {stride('la', 'lo', 100)} * gx + gy blocknum from (select *, {fl('ix / 24')} gx, {fl('iy / 28')} gy from (select *, {t(f'round_even({north("la", "lat_e7")}, 0) / 100')} ix, {t(f'round_even({east("la", "lo", "lat_e7", "lon_e7")}, 0) / 100')} iy from (select *, {fl('lat_e7 * 1e-7::double')} * 10000000 la, {fl('lon_e7 * 1e-7::double')} * 10000000 lo from points_world)))", "points_world"),
    "P13_pixel_offset": sql(f"select tile_lat, tile_lon, x, y, x + size * (size - y - 1) as offset, case when h = {VOID} then -1 else h end void_minus_one, nullif(h, {VOID}) void_null from pixels", "pixels"),
    "P14_grid_to_latlon": sql("select tile_lat, row, col, round(tile_lat + row * 100 / 111320.0::double, 9) lat, round(tile_lon + col * 100 / (111320.0::double * cos(radians(tile_lat + 0.5::double))), 9) lon from mosaic", "mosaic"),
    "P15_index_to_latlon": "select cast(k // 3584 as int) tile_lat, k // 896 blocknum, cast(k % 896 as int) i, " + lat_at("k // 3584 * 10000000", "k % 896 // 28 * 100") + " lat_e7, " + lon_at("k // 3584 * 10000000", "0", "k % 896 // 28 * 100", "k % 896 % 28 * 100") + " lon_e7 from (select o_orderkey k from orders)",
    "P16_validate_requests": sql("select request_id, radius, version, case version when 1 then 30 when 3 then 100 end spacing, case when lat is not null and lon > -180 and version <> 2 then 'ok' else 'Error with input' end status from requests", "requests"),
    "P18_altitude_rgb": sql(f"select tile_lat, row, col, case when h = 0 then 0 when lo = hi then 128 else cast(trunc({F4}) as int) end red, 0 green, case when h = 0 then 0 when lo = hi then 128 else cast(trunc(cast(255 * cast(1 - cast(cast(h - lo as float) / cast(hi - lo as float) as float)::double as float)::double as float)) as int) end blue from (select *, min(nullif(h, 0)) over (partition by tile_lat) lo, max(nullif(h, 0)) over (partition by tile_lat) hi from mosaic)", "mosaic"),
    "P19_diff_rgb": sql("select tile_lat, row, col, d diff, case when d = 0 then 0 else cast(trunc(greatest(0, r) * 255) as int) end red, case when d = 0 then 0 else cast(trunc(greatest(0, -r) * 255) as int) end blue from (select *, greatest(-1, least(1, d / case when p > 0 then p else most end::double)) r from (select *, hn - h d from mosaic) join pct using (tile_lat))", "mosaic", pct=PCT),
    "P20_hgt_spacing": sql("select distinct tile_lat, tile_lon, cast(4638 as bigint) m_25, cast(93 as bigint) m_1201, cast(31 as bigint) m_3601 from pixels", "pixels"),
    "S3_listing": sql(f"select page_id, count(*) links, cast(max(pos) as int) as last, min(href) least_href, max(href) most_href from (select page_id, pos, trim(regexp_extract(a, '(?is){HREF}', 1), chr(34) || chr(39)) href from (select page_id, unnest(l) a, generate_subscripts(l, 1) - 1 pos from (select page_id, regexp_extract_all(html, '(?is){HREF}[^>]*>.*?</a\\s*>', 0) l from pages)) where not contains(a, 'Parent Directory')) group by page_id"),
    "S4_catalogue_keys": sql("select tile_lat, tile_lon, max(filename) filename, count(*) paths from catalogue group by all", "catalogue"),
    "S5_tile_list": sql(f"select distinct list_lat tile_lat, list_lon tile_lon from (select {name_parts(STYLES['list'], 'list')} from tile_names) where list_lat is not null", "tile_names"),
    "G1_world_tiles": sql("select w.tile_lat, count(*) tiles, count(l.tile_lat) known from world w left join land l on l.tile_lat = w.tile_lat and l.tile_lon = w.tile_lon group by all", "world", "land"),
    "G2_enumerate_blocks": sql("select * from blocks", "catalogue", **block_views("(select distinct tile_lat, tile_lon from catalogue)", 500, 14)),
    "G3_grid_points": sql("select bl tile_lat, bo tile_lon, blocknum, cast(sum(lat_e7) as bigint) sum_lat, cast(sum(lon_e7) as bigint) sum_lon, count(*) n from grid_pts group by all", "pixels", **G4),
    "G4_generate_blocks": sql(SUMMARY, "raster", **G4, **heights4()),
    "G5_generate_ocean": sql("select tile_lat, tile_lon, blocknum, lat_e7, lon_e7, cast(0 as bigint) sum_h, 0 min_h, 0 max_h from blocks", "world", "land", **block_views("(select * from world where tile_lat between -60 and 59 and (tile_lat, tile_lon) not in (select (tile_lat, tile_lon) from land))", 5000, 4)),
    "G6_decimate": sql("select tile_lat, tile_lon, 9 size, cast(y // 3 as int) y, cast(x // 3 as int) x, h from raster where (24 - y) % 3 = 0 and x % 3 = 0", "raster"),
    "G7_mean_pool": sql(f"select tile_lat, tile_lon, cast((24 - y + 1) // 3 as bigint) as row, cast((x + 1) // 3 as bigint) col, {t('avg(h)')} h from pixels where h <> {VOID} group by all", "pixels"),
    "G8_resample_nearest": sql("select tile_lat, count(*) cells, cast(sum(h * (r.range * 1000 + c.range)) as bigint) weighed from (select tile_lat, max(row) mr, max(col) mc from mosaic group by all) d join range(300) r on r.range < trunc((mr + 1) * (100 / 60::double)) join range(300) c on c.range < trunc((mc + 1) * (100 / 60::double)) join mosaic m using (tile_lat) where m.row = least(trunc(r.range / (100 / 60::double)), mr) and m.col = least(trunc(c.range / (100 / 60::double)), mc) group by tile_lat", "mosaic"),
    "G9_mosaic": sql("select tile_lat, tile_lon, row, col, h from mosaic", "mosaic"),
    "G10_profile_points": sql("select tile_lat, tile_lon, cast(k.range as int) k, round(tile_lat + 0.5::double, 9) lat, round(tile_lon + k.range * s, 9) lon from (select *, 5000 / (111320.0::double * cos(radians(tile_lat + 0.5::double))) s from land) join range(60) k on k.range * s < 1.0", "land"),
    "G12_set_version_minor": sql("select version, case when version = 1 then 9::smallint else version_minor end version_minor, count(*) n from headers group by all", "headers"),
    "J1_classify_tiles": sql("select w.tile_lat, case when l.tile_lat is not null then 'land' when (select count(*) from land) > 1000 then 'ocean' else 'unknown' end kind, count(*) n from world w left join land l on l.tile_lat = w.tile_lat and l.tile_lon = w.tile_lon where w.tile_lat between -60 and 59 group by all", "world", "land"),
    "J2_consumers": sql("select cast(tile_lat - a.range as int) for_lat, cast(tile_lon - b.range as int) for_lon, count(*) sources, min(tile_lat) least_lat, max(tile_lon) most_lon from (select distinct tile_lat, tile_lon from pixels), range(2) a, range(2) b group by all", "pixels"),
    "J4_pending": sql("select * from world where tile_lat between -60 and 59 and (tile_lat, tile_lon) not in (select (tile_lat, tile_lon) from land)", "world", "land"),
    # a stored block is right if its version, spacing, bitmap and checksum are, and its corner lies within 2 both ways
    "J5_resume_blocks": sql("select tile_lat, tile_lon, blocknum, lat_e7, lon_e7 from (select tile_lat, tile_lon, blocknum, (tile_lat * 100 + blocknum) * 100000 + blocknum % 5 lat_e7, 70000000 + blocknum * 102000 - blocknum % 7 lon_e7 from headers) w where not exists (select 1 from headers c where c.version = 1 and c.spacing = 100 and c.bitmap = 72057594037927935 and c.blocknum % 47 <> 8 and c.tile_lat = w.tile_lat and c.blocknum = w.blocknum and abs(c.lat_e7 - w.lat_e7) <= 2 and abs(c.lon_e7 + case when c.blocknum % 53 = 9 then 5000000 else 0 end - w.lon_e7) <= 2)", "headers"),
    "J6_sample_blocks": sql("select point_id, round(h, 6) h from read", "cells", "points", near="select point_id, lat_e7 // 40000000 * 10000000 + lat_e7 % 450000 + point_id % 5 * 10000000 lat_e7, lon_e7 % 500000 lon_e7 from points", **in_blocks("near")),
    "J7_compare_profiles": sql("select s.point_id, height hgt_h, round(h, 6) dat_h, round(h - height, 6) diff from sampled s join read using (point_id)", "raster", "cells", "points", near="select point_id, lat_e7 % 450000 + point_id % 5 * 10000000 lat_e7, lon_e7 % 500000 lon_e7 from points", **in_blocks("near"), **sampled("near")),
    "J8_compare_stores": "select p_partkey as name, cast(len(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) <> upper(substr(p_name, i, 1)))) as bigint) differing from part where p_partkey % 3 = 0 and p_partkey % 10 <> 1 and p_name <> upper(p_name)",
    "J9_height_changes": sql("select tile_lat, tile_lon, cast(count(*) as bigint) points, count(*) filter (new <> old) changed, cast(count(*) filter (fixed) as bigint) zero_to_positive, coalesce(max(new) filter (fixed), 0) max_altitude, coalesce(max(new) filter (fixed and lone), max(new) filter (fixed), 0) report_altitude, coalesce(min(blocknum * 896 + i) filter (fixed and lone and new = bl), min(blocknum * 896 + i) filter (fixed and bl is null and new = ba), 0) report_idx from (select *, max(case when fixed and lone then new end) over (partition by tile_lat) bl, max(case when fixed then new end) over (partition by tile_lat) ba from (select *, old = 0 and new > 0 fixed, i // 28 between 1 and 30 and i % 28 between 1 and 26 and l = 0 and r = 0 and u = 0 and d = 0 lone from (select *, lag(old) over b l, lead(old) over b r, lag(old, 28) over b u, lead(old, 28) over b d from cells window b as (partition by blocknum order by i)))) group by all", "cells"),
    "J10_diff_mosaics": sql("select tile_lat, cast(count(*) filter (d <> 0) as bigint) changed, min(d) least, max(d) most, count(*) cells from (select m.tile_lat, hn - coalesce(b.h, 0) d from mosaic m left join (select tile_lat, (blocknum % 4 // 2) * 24 + i // 32 as row, (blocknum % 2) * 28 + i % 32 as col, arg_max(old, blocknum) h from cells where blocknum % 3 > 0 group by all) b on b.tile_lat = m.tile_lat and b.row = m.row and b.col = m.col) group by all", "mosaic"),
    "J11_cover_requests": sql("select *, abs(tile_lat) > 84 outside from cover", "cover"),
    "J12_resolve_requests": sql("select request_id, count(*) filter (abs(c.tile_lat) <= 84) tiles, count(*) filter (abs(c.tile_lat) > 84) outside, case when bool_and(l.tile_lat is not null or abs(c.tile_lat) > 84) then 'ok' else 'Cannot generate terrain' end status from cover c left join land l on l.tile_lat = c.tile_lat and l.tile_lon = c.tile_lon group by all", "cover", "land"),
    "A1_tiles_by_continent": sql("select continent, cast(count(*) as int) n, md5(string_agg(replace(filename, '.hgt.zip', '.DAT.gz'), ',' order by filename)) digest from (select distinct continent, filename from catalogue) where continent not in ('', 'USGS') group by all", "catalogue"),
    "A2_steep_hgt": sql(f"select tile_lat, tile_lon, cast(count(*) filter (d > 2000) as bigint) steep, max(d) max_diff, round(tile_lat + 1.0::double - arg_max(24 - y, o) filter (d is not null) / 24::double, 9) max_lat, round(tile_lon + arg_max(x, o) filter (d is not null) / 24::double, 9) max_lon from (select *, case when d is not null then d * 10000 + case when kind = 'h' then 5000 else 0 end - ((24 - y) * 25 + x) end o from (select tile_lat, tile_lon, y, x, 'h' kind, abs(lead(v) over (partition by tile_lat, tile_lon, y order by x) - v) d from r union all select tile_lat, tile_lon, y, x, 'v', case when lead(y) over w = y - 1 then abs(lead(v) over w - v) end from r window w as (partition by tile_lat, tile_lon, x order by y desc))) group by tile_lat, tile_lon", "raster", r=f"select *, nullif(h, {VOID}) v from raster"),
    "A3_steep_blocks": sql("select tile_lat, tile_lon, cast(count(*) filter (d > 2000) as bigint) steep, max(d) max_diff, arg_max(blocknum, o) filter (d is not null) blocknum, cast(arg_max(i // 32, o) filter (d is not null) as bigint) gx, cast(arg_max(i % 32, o) filter (d is not null) as bigint) gy from (select *, case when d is not null then d::hugeint * 10000000000 - blocknum * 10000 + case when kind = 'h' then 5000 else 0 end - i end o from (select *, 'h' kind, case when i % 32 < 31 then abs(lead(old) over b - old) end d from cells window b as (partition by blocknum order by i) union all select *, 'v', abs(lead(old, 32) over b - old) from cells window b as (partition by blocknum order by i))) group by all", "cells"),
    "A4_zero_mix": sql("select tile_lat, tile_lon, cast(count(*) filter (old = 0) as bigint) zeros, count(*) total, count(*) filter (old = 0) > 0 and count(*) filter (old = 0) < count(*) affected from cells group by all", "cells"),
    "A5_tile_altitude_range": sql("select tile_lat, min(nullif(h, 0)) lo, max(nullif(h, 0)) hi from mosaic group by all", "mosaic"),
    "A6_version_minor_audit": sql("select tile_lat, tile_lon, coalesce(string_agg(distinct version_minor::varchar, ',' order by version_minor::varchar) filter (version = 1), '') versions, case count(distinct case when version = 1 then version_minor end) when 0 then 'no valid blocks' when 1 then 'single' else 'mixed' end state from headers group by all", "headers"),
    "A7_check_blocks": sql("select tile_lat, blocknum, reason from checked", "checked"),
    "A8_check_tiles": sql("select *, cast(count_bad as int) + cast(first_bad is not null as int) + cast(range_bad as int) errors from (select tile_lat, tile_lon, count(*) blocks, max(fb) first_bad, max(case when blocknum = fb then reason end) reason, count(*) < case when abs(tile_lat) >= 78 then 100 else 100 end or count(*) > 6000 count_bad, not (coalesce((max(lat_e7) filter (ok) - min(lat_e7) filter (ok)) * 1e-7::double, 999) between 0.99 and 1.01) or coalesce((max(lon_e7) filter (ok) - min(lon_e7) filter (ok)) * 1e-7::double, 999) < 1.0 or coalesce((max(lon_e7) filter (ok) - min(lon_e7) filter (ok)) * 1e-7::double, 999) > case when abs(tile_lat) > 60 then 1.4 else 1.08 end range_bad from (select *, fb is null or blocknum < fb ok from (select *, min(case when reason is not null then blocknum end) over (partition by tile_lat) fb from checked)) group by tile_lat, tile_lon)", "checked"),
    "A9_status_summary": "select case o_orderstatus when 'O' then 'ok' when 'F' then 'skipped' else 'error' end status, count(*) n from orders group by all",
    "A10_distinct_tiles": sql("select tile_lat, tile_lon, min(request_id) first_request from cover group by all", "cover"),
    "A11_block_height_stats": sql("select tile_lat, max(old) max_h, cast(count(*) filter (old > 0) as bigint) positive, count(*) total from cells group by all", "cells"),
    "A12_abs_diff_percentile": sql("select tile_lat, round(p, 6) p, most from pct", "mosaic", pct=PCT),
    "W1_neighbour_differences": sql(f"select tile_lat, tile_lon, x, y, h - lag(h) over (partition by tile_lat, tile_lon, y order by x) dx, h - lag(h) over (partition by tile_lat, tile_lon, x order by y) dy from pixels where h <> {VOID}", "pixels"),
    "W2_first_of_the_largest": sql("select tile_lat, tile_lon, h, x, y from (select *, row_number() over (partition by tile_lat, tile_lon order by h desc, y, x) r from pixels) where r = 1", "pixels"),
    "W3_before_first_bad": sql("select tile_lat, blocknum from (select *, min(case when reason is not null then blocknum end) over (partition by tile_lat) fb from checked) where fb is null or blocknum < fb", "checked"),
    "W4_last_writer": sql("select tile_lat, tile_lon, max(k) k, arg_max(continent, k) continent from catalogue group by all", "catalogue"),
    "W5_bounds_beside_cells": sql(f"select tile_lat, tile_lon, x, y, v - min(v) over (partition by tile_lat, tile_lon) above_least, max(v) over (partition by tile_lat, tile_lon) - v below_most from (select *, nullif(h, {VOID}) v from pixels)", "pixels"),
    "R1_steep_report": "",
    "R2_ordered_tiles": sql("select * from land order by tile_lat, tile_lon", "land"),
    "X1_common_names": sql("select filename, 'both' side from (select filename from catalogue where k % 2 = 0 intersect select filename from catalogue where k % 3 = 0) union all select filename, 'first' from (select filename from catalogue where k % 2 = 0 except select filename from catalogue where k % 3 = 0)", "catalogue"),
    "X2_world_minus_land": sql("select tile_lat, count(*) n, min(tile_lon) west from world where tile_lat between -60 and 59 and (tile_lat, tile_lon) not in (select (tile_lat, tile_lon) from land) group by all", "world", "land"),
    "X3_land_and_ocean": "",
    "X4_planning_modes": sql(f"select 'world' as mode, count(*) n from world where tile_lat between -60 and 59 union all select 'existing', count(*) from land union all select 'list', count(*) from (select distinct list_lat, list_lon from (select {name_parts(STYLES['list'], 'list')} from tile_names) where list_lat is not null)", "world", "land", "tile_names"),
    "T1_stream_cover": sql("select abs(tile_lat) > 84 outside, count(*) n from cover group by all", "cover"),
    "T3_expired": "select count(*) n, max(event_id) as last from events where ts < (select max(ts) - interval 24 hours from events)",
}
ORACLES["R1_steep_report"] = f"select tile_lat, tile_lon, steep, max_diff from ({ORACLES['A2_steep_hgt']}) where steep > 0 order by max_diff desc, tile_lat, tile_lon limit 20"
EVERY = "(select tile_lat, tile_lon from low union select tile_lat, tile_lon from world where tile_lat between -60 and 59)"
# heights of the ocean are 0 by definition, so only blocks of land are sampled
X3 = block_views(EVERY, 1000, 8) | {
    "land_blocks": "select * from blocks where (tile_lat, tile_lon) in (select (tile_lat, tile_lon) from low)",
    "grid_pts": point_views(1000)["grid_pts"].replace("from blocks b", "from land_blocks b"),
}
SUMS = "(select tile_lat, tile_lon, blocknum, sum(h) s from heights group by all)"
ORACLES["X3_land_and_ocean"] = sql(f"select tile_lat, tile_lon, count(*) blocks, cast(coalesce(sum(s), 0) as bigint) sum_h from blocks left join {SUMS} using (tile_lat, tile_lon, blocknum) group by all", "world", "raster", low="select distinct tile_lat, tile_lon from pixels", **X3, **heights4())
EVERY_ROW = f"select t.tile_lat, t.tile_lon, cast(y.range as int) y, x.range x, coalesce(p.h, {VOID}) h from (select distinct tile_lat, tile_lon from pixels) t cross join range(25) y cross join range(25) x left join pixels p on p.tile_lat = t.tile_lat and p.tile_lon = t.tile_lon and p.y = y.range and p.x = x.range"
BY_BLOCK = "select tile_lat, tile_lon, cast(blocknum % 4 as int) n, sum(old) s, sum(old * (i + 1)) w, md5(string_agg(printf('%02x%02x', old & 255, (old >> 8) & 255), '' order by i)) hex from cells group by all"
AROUND = f"select *, lead(b) over up e from (select *, lead(a) over (partition by tile_lat, tile_lon, y order by x) b, lead(a) over up c from (select *, nullif(h, {VOID}) a from pixels) window up as (partition by tile_lat, tile_lon, x order by y)) window up as (partition by tile_lat, tile_lon, x order by y)"


def weighed(a: str, b: str, w: str) -> str:
    return f"coalesce({b} * {w} + {a} * (1 - {w}), {a}, {b})"


def between(fx: str, fy: str) -> str:
    return weighed(f"({weighed('a', 'b', fx)})", f"({weighed('c', 'e', fx)})", fy)


ORACLES |= {
    "S1_read_hgt": sql("select tile_lat, tile_lon, 1201 size, cast(y * 50 + r.range as int) y, sum_h, min_h, cast(null as varchar) error from (select tile_lat, tile_lon, y, cast(sum(h * case when x < 24 then 50 else 1 end) as bigint) sum_h, min(h) min_h from every_row group by all) join range(50) r on y < 24 or r.range = 0", "pixels", every_row=EVERY_ROW),
    "S2_read_dat": sql("select cast(2048 * (max(n) over (partition by tile_lat) + 1) as bigint) file_bytes, n blocknum, 72057594037927935 as bitmap, tile_lat * 10000000::bigint + n lat_e7, cast(n * 2000 as bigint) lon_e7, 1 as version, 100 spacing, n // 2 grid_idx_x, n % 2 grid_idx_y, tile_lat lat_degrees, 0 lon_degrees, cast(null as varchar) error, 1 version_minor, cast(w as bigint) weighed from by_block", "cells", by_block=BY_BLOCK),
    "S7_write_bundle": sql("select 'lat' || tile_lat // 10 as key, cast(count(distinct tile_lat) as int) members, 'ok' status from cells group by all", "cells"),
    "S9_write_blocks": sql("select 100 spacing, tile_lat, tile_lon, count(*) blocks, cast(sum(s) as bigint) sum_h from by_block group by all", "cells", by_block=BY_BLOCK),
    "S10_scan_tiles": sql("select distinct tile_lat, tile_lon from cells", "cells"),
    "P10_void_to": sql(f"select tile_lat, tile_lon, x, y, case h when {VOID} then 0 else h end as zero, nullif(h, {VOID}) as none from pixels", "pixels"),
    "P11_bilinear": sql(f"select tile_lat, tile_lon, x, y, {between('(x % 4 / 4.0::double)', '(y % 8 / 8.0::double)')} as value from around", "pixels", around=AROUND),
    "P12_fill_height": sql(f"select tile_lat, tile_lon, x, y, cast(trunc({between('0.5::double', '0.25::double')} - 1000) as smallint) filled from around", "pixels", around=AROUND),
    # bit by bit, the highest first, by the polynomial x^16 + x^12 + x^5 + 1
    "P17_crc16_xmodem": "select p_partkey, cast(list_reduce(list_prepend(0, flatten(list_transform(string_split(p_name, ''), lambda c: list_transform(range(8), lambda b: (ord(c) >> cast(7 - b as int)) & 1)))), lambda r, b: xor((r << 1) & 65535, xor(r >> 15, b) * 4129)) as int) crc from part",
    "G11_pack_blocks": sql("select tile_lat, n blocknum, 2048 as bytes, tile_lat * 10000000::bigint + n lat_e7, cast(n * 2000 as bigint) lon_e7, cast(100 as bigint) spacing, hex heights, true sealed from by_block", "cells", by_block=BY_BLOCK),
}
# files of a store with faults, by the tile's latitude: cut off, emptied, short by the padding, and not to be read
FAULTS = "select tile_lat, case tile_lat % 7 when 1 then 'size' when 2 then 'empty' when 3 then 'short' when 4 then 'unread' else 'whole' end fault, printf('N%02dE000.DAT.gz', tile_lat) as name, count(distinct blocknum) n from cells group by all"
NAMES = "select distinct case continent when '' then 'none' else continent end continent, filename, tile_lat, tile_lon from catalogue"
# the first request makes a bundle, and so does the first one that comes a day or more after one was made
MADE = "select user_id, min(ts) made from events where user_id is not null group by all union all select c.user_id, (select min(ts) from events e where e.user_id = c.user_id and e.ts >= c.made + interval 24 hours) from chain c where c.made is not null"
ORACLES |= {
    "S4_build_catalogue": sql("select tile_lat, tile_lon, max(continent) continent, max(filename) filename from names group by all", "catalogue", names=NAMES),
    "S11_store_size": sql("select cast(sum(length(filename)) as bigint) bytes from names", "catalogue", names=NAMES),
    # blocks lie some units apart, so every file that is looked at has a bad extent
    "A8_check_files": sql("select tile_lat, 0 tile_lon, case when fault in ('size', 'empty', 'unread') then 0 else n end blocks, cast(null as int) first_bad, cast(null as varchar) reason, fault = 'unread' unread, fault = 'size' bad_size, fault = 'size' or fault in ('whole', 'short') and n < 2 count_bad, fault in ('whole', 'short') range_bad, cast(case fault when 'empty' then 0 when 'unread' then 1 when 'size' then 2 else case when n < 2 then 2 else 1 end end as int) errors from faults", "cells", faults=FAULTS),
    "G12_set_version_in_files": sql("select name, case fault when 'size' then 'bad file size' when 'empty' then 'bad file size' when 'unread' then 'unreadable' else 'set' end status, case when fault in ('whole', 'short') then n end blocks, case when fault in ('whole', 'short') then 9 end version_minor, case when fault in ('whole', 'short') then 0 end bad_crc from faults", "cells", faults=FAULTS),
    "A3_steep_stored_blocks": sql("select tile_lat, tile_lon, steep, max_diff, n blocknum, gx, gy, round((tile_lat * 10000000 + n) * 1e-7::double + gx * 100 / 111111.0::double, 9) max_lat, round(n * 2000 * 1e-7::double + gy * 100 / (111111.0::double * greatest(cos(radians((tile_lat * 10000000 + n) * 1e-7::double)), 0.01)), 9) max_lon from (select tile_lat, tile_lon, cast(count(*) filter (d > 2000) as bigint) steep, coalesce(max(d), 0) max_diff, cast(arg_max(blocknum, o) filter (d > 0) as int) % 4 n, cast(arg_max(i // 32, o) filter (d > 0) as bigint) gx, cast(arg_max(i % 32, o) filter (d > 0) as bigint) gy from (select *, case when d is not null then d::hugeint * 10000000000 - blocknum * 10000 + case when kind = 'h' then 5000 else 0 end - i end o from (select *, 'h' kind, case when i % 32 < 31 then abs(lead(v) over b - v) end d from heights window b as (partition by blocknum order by i) union all select *, 'v', abs(lead(v, 32) over b - v) from heights window b as (partition by blocknum order by i))) group by all)", "cells", heights="select *, case when tile_lat % 5 = 3 then 7 else old end v from cells"),
    "J8_store_summary": "select count(*) compared, count(*) filter (p_partkey % 7 = 0 or p_partkey % 3 = 0 and p_name <> upper(p_name)) differ from part where p_partkey % 10 <> 1",
    "A4_zero_mix_before": sql("select tile_lat, tile_lon, cast(count(*) filter (old = 0) as bigint) zeros, count(*) total, count(*) filter (old = 0) > 0 and count(*) filter (old = 0) < count(*) and max(tile_lat) % 30 <= 11 affected from cells group by all", "cells"),
    "G6_decimate_status": sql("select tile_lat, tile_lon, case tile_lon when 0 then 'ok' when 1 then 'not SRTM1 (size=1201)' when 2 then 'not SRTM1 (size=unknown)' else 'not SRTM1 (size=25)' end status from (select distinct tile_lat, tile_lon from pixels)", "pixels"),
    "P20_spacing_of_sizes": "select p_partkey, cast(round_even(111320 / (p_partkey + 1)::double, 0) as bigint) metres from part",
    "J3_sample_keyed_raster": ORACLES["J3_sample_hgt"],
    "J6_sample_keyed_blocks": ORACLES["J6_sample_blocks"],
    "J7_compare_keyed_profiles": ORACLES["J7_compare_profiles"],
    "T2_stream_generate": sql("select tile_lat, tile_lon, count(*) blocks, cast(0 as bigint) differing from blocks group by all", "pixels", **block_views("(select distinct tile_lat, tile_lon from pixels)", 1000, 8)),
    "T3_bundle_life": f"with recursive chain as ({MADE}) select user_id, count(*) made, (select count(*) from events e where e.user_id = c.user_id) - count(*) repeat, count(*) filter (made + interval 24 hours <= (select max(ts) from events)) expired from chain c where made is not null group by user_id",
}
