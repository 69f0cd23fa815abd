"""Block differences, steepness by strips, keyed tables, bundles, patched files, listings and broken rasters."""

import binascii
import gzip
import random
import re
import tracemalloc
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdem.functions import geo
from sparkdem.operators import audit, grid, sampling
from sparkdem.sources import files
from tests.test_files import block


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_blocks(spark, seed, lost=0.0, twice=False):
    """Four by five blocks of two tiles with numbers in no order, some of them lost, some there twice."""
    rng = random.Random(seed)
    rows = []
    for tile in (1, 2):
        places = [(x, y) for x in range(4) for y in range(5) if rng.random() >= lost]
        numbers = rng.sample(range(1000), 2 * len(places))
        for x, y in places:
            for n in range(1 + (twice and rng.random() < 0.3)):
                rows.append((tile, 0, numbers.pop(), x, y, [rng.randint(-9, 9) for _ in range(896)]))
    return spark.createDataFrame(rows, "tile_lat int, tile_lon int, blocknum long, grid_idx_x long, grid_idx_y long, heights array<smallint>")


@pytest.mark.parametrize("lost,twice", [(0, False), (0.4, False), (0.3, True)])
def test_block_differences_are_those_of_mosaics(spark, lost, twice):
    a, b = random_blocks(spark, 1, lost, twice), random_blocks(spark, 2, lost, twice)
    want = audit.diff_mosaics(grid.mosaic(a), grid.mosaic(b))
    got = audit.diff_blocks(a, b)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    empty = a.where("false")
    assert audit.diff_blocks(a, empty).agg(F.sum("diff")).first() == grid.mosaic(a).agg(F.sum("h")).first() and audit.diff_blocks(empty, empty).count() == 0


def test_no_exchange_of_cells(spark):
    a, b = random_blocks(spark, 3), random_blocks(spark, 4)
    for df in (audit.diff_blocks(a, b), audit.diff_summary(audit.diff_blocks(a, b)), audit.abs_diff_percentile(audit.diff_blocks(a, b))):
        lines = plan_of(df).splitlines()
        explode = next(i for i, x in enumerate(lines) if "Generate explode(" in x)
        above = [x for x in lines[:explode] if "Exchange" in x]
        assert len(above) <= 1  # partial sums by tile
        assert all("partial" in "".join(lines[i + 1 : i + 4]) for i, x in enumerate(lines[:explode]) if "Exchange" in x)
    plan = plan_of(audit.altitude_rgb(grid.mosaic(a)))
    assert "Window" not in plan


def test_colours_of_heights(spark):
    cells = spark.createDataFrame([(0, 0, 0, c, h) for c, h in enumerate([0, 100, 300, 500])] + [(1, 0, 0, 0, 7), (1, 0, 0, 1, 0), (2, 0, 0, 0, 0)], "tile_lat int, tile_lon int, row int, col int, h int")
    grey = {(r.tile_lat, r.col): (r.red, r.green, r.blue) for r in audit.altitude_rgb(cells, grey=True).collect()}
    assert grey == {(0, 0): (0, 0, 0), (0, 1): (0, 0, 0), (0, 2): (127, 127, 127), (0, 3): (255, 255, 255), (1, 0): (128, 128, 128), (1, 1): (0, 0, 0), (2, 0): (0, 0, 0)}
    warm = {(r.tile_lat, r.col): (r.red, r.green, r.blue) for r in audit.altitude_rgb(cells).collect()}
    assert warm == {(0, 0): (0, 0, 0), (0, 1): (0, 0, 255), (0, 2): (127, 0, 127), (0, 3): (255, 0, 0), (1, 0): (128, 0, 128), (1, 1): (0, 0, 0), (2, 0): (0, 0, 0)}


def steep(h, threshold, lat, lon):
    """The definition over a whole raster, north row first."""
    size = len(h)
    f = np.where(h == geo.VOID, np.nan, h.astype(float))
    across, down = np.abs(np.diff(f, axis=1)), np.abs(np.diff(f, axis=0))
    n = int((across > threshold).sum() + (down > threshold).sum())
    top = lambda d: -1 if np.isnan(d).all() else np.nanmax(d)
    a, b = top(across), top(down)
    if max(a, b) < 0:
        return (n, None, lat + 1.0, float(lon))
    row, col = (0, 0) if max(a, b) == 0 else np.argwhere((across if a >= b else down) == max(a, b))[0]
    return (n, int(max(a, b)), lat + 1.0 - row / (size - 1), lon + col / (size - 1))


@pytest.mark.parametrize("order", ["files", "north first", "shuffled", "gaps"])
@pytest.mark.parametrize("strip", [5, 256])
def test_steepness_by_strips(spark, monkeypatch, order, strip):
    monkeypatch.setattr(audit, "STRIP_ROWS", strip)
    rng, rows, want = np.random.default_rng(7), [], {}
    for lat, size, most in ((1, 37, 60), (2, 37, 3), (3, 25, 1), (4, 25, 2)):
        h = rng.integers(0, most, (size, size)).astype(np.int16)
        h[rng.random(h.shape) < (1.0 if lat == 4 else 0.1)] = geo.VOID
        there = [y for y in range(size) if order != "gaps" or y % 7]
        rows += [(lat, 9, size, y, h[size - 1 - y].tolist()) for y in (reversed(there) if order == "north first" else there)]
        if order == "gaps":
            h = h.astype(float)
            h[[size - 1 - y for y in range(size) if y % 7 == 0]] = geo.VOID
        want[lat] = steep(h, 2, lat, 9)
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "tile_lat int, tile_lon int, size int, y int, h array<smallint>")
    got = {r.tile_lat: (r.steep, r.max_diff, r.max_lat, r.max_lon) for r in audit.steep_hgt(df, 2).collect()}
    assert got.keys() == want.keys()
    for lat, r in got.items():
        assert r[:2] == want[lat][:2] and r[2:] == pytest.approx(want[lat][2:]), lat
    if order == "files":  # outer rows of strips only: two for each tile in each partition
        assert audit.strips(df, 2).where("halo is not null").count() <= 2 * (4 + 5)


def test_steep_blocks_have_positions(spark):
    flat, peak = [5] * 896, [5] * 896
    peak[3 * 32 + 4] = 105
    rows = [(45, 7, 0, 450_000_000, 70_000_000, 1, 100, flat), (45, 7, 1, 450_216_000, 70_000_000, 1, 100, peak), (45, 7, 2, 0, 0, 0, 0, [9, 0] * 448), (46, 7, 0, 460_000_000, 70_000_000, 1, 100, flat), (47, 7, 0, 0, 0, 0, 0, [9, 0] * 448)]
    df = spark.createDataFrame(rows, "tile_lat int, tile_lon int, blocknum int, lat_e7 long, lon_e7 long, version int, spacing int, heights array<smallint>")
    got = {r.tile_lat: r for r in audit.steep_blocks(df, 50).collect()}
    r = got[45]
    assert (r.steep, r.max_diff, r.blocknum, r.gx, r.gy) == (4, 100, 1, 3, 3)
    assert r.max_lat == pytest.approx(45.0216 + 300 / 111111) and r.max_lon == pytest.approx(7 + 300 / (111111 * np.cos(np.radians(45.0216))))
    for lat in (46, 47):
        assert (got[lat].steep, got[lat].max_diff, got[lat].blocknum, got[lat].max_lat) == (0, 0, None, None)


def test_resumed_blocks_lie_where_they_should(spark, tmp_path):
    cases = {"N45E007.DAT": [block(450_000_000 + a, 70_000_000 + o, 0, i, [1] * 896) for i, (a, o) in enumerate([(0, 0), (2, -2), (3, 0), (0, 3), (0, 5_000_000), (0, 0)])]}
    spoiled = bytearray(cases["N45E007.DAT"][5])
    spoiled[700] ^= 4
    (tmp_path / "N45E007.DAT.gz").write_bytes(gzip.compress(b"".join(cases["N45E007.DAT"][:5]) + bytes(spoiled)))
    stored = files.read_dat(spark, str(tmp_path)).selectExpr("*", "lat_degrees as tile_lat", "lon_degrees as tile_lon")
    work = spark.range(7).selectExpr("45 tile_lat", "7 tile_lon", "cast(id as int) blocknum", "450000000L lat_e7", "70000000L lon_e7")
    assert sorted(r.blocknum for r in audit.resume_blocks(work, stored, 100).collect()) == [2, 3, 4, 5, 6]
    assert sorted(r.blocknum for r in audit.resume_blocks(work, stored, 100, with_crc=False).collect()) == [2, 3, 4, 6]


def test_broken_rasters_are_no_files(spark, tmp_path):
    rows = [(1, 0, y, [y] * 4) for y in (0, 1, 3)] + [(2, 0, y, [y] * 4) for y in (0, 1, 2, 2)] + [(3, 0, y, [y] * (4 - (y == 2))) for y in range(4)] + [(4, 0, y, [y] * 4) for y in range(4)] + [(5, 0, 0, [1]), (5, 0, None, None)]
    df = spark.createDataFrame(rows, "tile_lat int, tile_lon int, y int, h array<smallint>")
    got = {r.name: r for r in files.write_hgt(df, f"file://{tmp_path}/out").collect()}
    assert {n: r.status[:6] for n, r in got.items()} == {"N01E000.hgt": "failed", "N02E000.hgt": "failed", "N03E000.hgt": "failed", "N04E000.hgt": "ok", "N05E000.hgt": "failed"}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["N04E000.hgt.zip"] and got["N01E000.hgt"].path is None


def test_repeated_raster_rows_give_a_point_once(spark):
    rows = [(45, 7, 25, y, [y * 10 + k] * 25, p) for k, p in ((0, "a/N45E007.hgt"), (5, "b/N45E007.hgt")) for y in range(25)]
    df = spark.createDataFrame(rows, "tile_lat int, tile_lon int, size int, y int, h array<smallint>, path string")
    points = spark.createDataFrame([(1, 455_000_000, 75_000_000), (2, 451_000_000, 71_000_000)], "id long, lat_e7 long, lon_e7 long")
    for rasters, extra in ((df, 5), (df.unionAll(df), 5), (df.drop("path"), 5)):
        assert {r.id: r.height for r in sampling.sample_hgt(points, rasters).collect()} == {1: 120 + extra, 2: 24 + extra}


@pytest.fixture
def keyed(spark, tmp_path):
    rows = [(a, o, 25, y, [int((a * 7 + o * 3 + y * x) % 900) for x in range(25)]) for a in (45, 46) for o in (7, 8) for y in range(25)]
    rasters = spark.createDataFrame([*rows, *rows[:30]], "tile_lat int, tile_lon int, size int, y int, h array<smallint>")
    blocks = random_blocks(spark, 5, twice=True).selectExpr("tile_lat + 44 as tile_lat", "7 as tile_lon", "blocknum", "grid_idx_x", "grid_idx_y", "heights")
    a = files.write_keyed(rasters, f"r{uuid.uuid4().hex}", f"{tmp_path}/r", files.RASTER_KEYS, 4)
    b = files.write_keyed(blocks, f"b{uuid.uuid4().hex}", f"{tmp_path}/b", files.BLOCK_KEYS, 4, "blocknum")
    points = spark.range(300).selectExpr("id", "450000000 + id * 65537 % 20000000 + 0L as lat_e7", "70000000 + id * 104729 % 20000000 + 0L as lon_e7")
    near = spark.range(300).selectExpr("id", "450000000 + id % 2 * 10000000 + id * 911 % 80000 as lat_e7", "70000000 + id * 613 % 120000 as lon_e7")
    return rasters, blocks, a, b, points.unionAll(near.withColumn("id", F.col("id") + 1000))


def test_points_come_to_keyed_tables(spark, keyed, tmp_path):
    rasters, blocks, a, b, points = keyed
    assert a.count() == 100 and b.count() == blocks.select(files.BLOCK_KEYS).distinct().count()
    want = {r.id: r.height for r in sampling.sample_hgt(points, rasters).collect()}
    got = sampling.sample_hgt(points, a, keyed=True)
    assert {r.id: r.height for r in got.collect()} == want and len(set(want.values())) > 50
    want_b = {r.id: r.h for r in sampling.sample_blocks(points, blocks, 100).collect()}
    got_b = sampling.sample_blocks(points, b, 100, keyed=True)
    assert {r.id: r.h for r in got_b.collect()} == want_b and sum(h is not None for h in want_b.values()) > 100
    profile = {r.id: (r.hgt_h, r.dat_h) for r in sampling.compare_profiles(points, "id", a, b, 100, keyed=True).collect()}
    assert profile == {i: (want[i], want_b[i]) for i in want}
    # however large the points are, nothing of the tables' arrays is shuffled
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df, column in ((sampling.sample_hgt(points, a, keyed=True), "h#"), (sampling.sample_blocks(points, b, 100, keyed=True), "heights#")):
            lines = plan_of(df).splitlines()
            scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x and column in x.split("ReadSchema")[0]]
            assert scans and all("Bucketed: true" in lines[i] for i in scans)
            deep = [len(m[0]) if (m := re.match("[ :]*(?=[+:]- )", x)) else -1 for x in lines]
            for i in scans:
                above, depth = [], deep[i]
                for j in range(i - 1, -1, -1):  # those that this scan stands under
                    if deep[j] < depth:
                        above.append(lines[j])
                        depth = deep[j]
                join = next(k for k, x in enumerate(above) if "Join" in x)
                assert not any("Exchange" in x for x in above[:join]), "\n".join(lines)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_stream_of_points_reads_keyed_tables(spark, keyed, tmp_path):
    rasters, blocks, a, b, points = keyed
    points.write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "points"))
    both = sampling.compare_profiles(stream, "id", a, b, 100, keyed=True)
    q = both.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sampling.compare_profiles(points, "id", a, b, 100, keyed=True)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_bundle_takes_a_chunk_of_memory(tmp_path):
    big = np.random.default_rng(1).integers(0, 3, 40_000_000).astype(np.uint8).tobytes()
    for n in (1, 2):
        with gzip.open(tmp_path / f"N0{n}E000.DAT.gz", "wb", compresslevel=1) as f:
            f.write(big)
    tracemalloc.start()
    store, where = files.store_of(f"file://{tmp_path}")
    with store.open_output_stream(f"{where}/out.zip") as out:
        files.zip_members([f"file:{tmp_path}/N01E000.DAT.gz", f"{tmp_path}/N02E000.DAT.gz"], out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and (tmp_path / "out.zip").stat().st_size > 8_000_000
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and z.namelist() == ["N01E000.DAT", "N02E000.DAT"] and z.read("N02E000.DAT") == big


def test_bundles_in_parts_appear_whole_or_not_at_all(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n in range(7):
        (src / f"N0{n}E000.DAT.gz").write_bytes(gzip.compress(random.Random(n).randbytes(3000)))
    (src / "N08E000.DAT.gz").write_bytes(b"not compressed")
    listed = files.listed(spark, str(src), "*.DAT.gz").select("path", "length", F.regexp_extract("path", r"N(\d\d)", 1).cast("int").alias("n"))
    keyed = listed.where("n < 7").withColumn("key", F.lit("all")).unionByName(listed.withColumn("key", F.lit("bad"))).unionByName(listed.where("n < 2").withColumn("key", F.lit("small")))
    keyed = keyed.unionByName(spark.createDataFrame([(None, None, 1, "gone")], keyed.schema))
    out = tmp_path / "zips"
    got = {r.key: r for r in files.write_bundle(keyed, "key", f"file://{out}", part_bytes=7000).collect()}
    assert {k: (r.parts, r.members, r.status) for k, r in got.items()} == {"all": (3, 7, "ok"), "small": (1, 2, "ok"), "bad": (0, 0, "failed: BadGzipFile"), "gone": (0, 0, "failed: FileNotFoundError")}
    assert sorted(p.name for p in out.iterdir()) == ["all-2.zip", "all-3.zip", "all.zip", "small.zip"]
    members = {}
    for p in out.glob("all*.zip"):
        with zipfile.ZipFile(p) as z:
            members |= {n: z.read(n) for n in z.namelist()}
    assert members == {f"N0{n}E000.DAT": random.Random(n).randbytes(3000) for n in range(7)}


@pytest.fixture
def faulty(tmp_path):
    src = tmp_path / "faulty"
    src.mkdir()
    good = [block(450_000_000, 70_000_000 + i, 0, i, [100 + i] * 896) for i in range(3)]
    wrong = bytearray(good[1])
    wrong[500] ^= 1
    cases = {
        "N45E007.DAT.gz": gzip.compress(good[0] + bytes(wrong) + bytes(2048) + good[2][:1821]), "N46E007.DAT": b"".join(good), "N47E007.DAT.gz": gzip.compress(bytes(4096)),
        "N48E007.DAT.gz": gzip.compress(good[0] + good[1][:700]), "N49E007.DAT.gz": gzip.compress(good[0])[:-30], "N50E007.DAT.gz": gzip.compress(b""),
    }
    for name, data in cases.items():
        (src / name).write_bytes(data)
    return src, good, bytes(wrong)


def test_version_is_patched_in_files(spark, faulty, tmp_path):
    src, good, wrong = faulty
    out = tmp_path / "out"
    got = {r.name: r.status for r in files.set_version_minor_in_files(spark, str(src), f"file://{out}", 7).collect()}
    assert got == {"N45E007.DAT.gz": "set", "N46E007.DAT": "set", "N47E007.DAT.gz": "no valid blocks", "N48E007.DAT.gz": "bad file size", "N49E007.DAT.gz": "unreadable: EOFError", "N50E007.DAT.gz": "bad file size"}
    assert sorted(p.name for p in out.iterdir()) == ["N45E007.DAT.gz", "N46E007.DAT"]
    patched = lambda b: b[:1821] + b"\x07" + b[1822:]
    data = (out / "N45E007.DAT.gz").read_bytes()
    # the checksums stay, the wrong one too; the short last block is filled up
    assert gzip.decompress(data) == patched(good[0]) + patched(wrong) + bytes(2048) + patched(good[2][:1821] + bytes(227)) and b"N45E007.DAT\0" in data[:40]
    assert (out / "N46E007.DAT").read_bytes() == b"".join(map(patched, good))
    more = {r.name for r in files.set_version_minor_in_files(spark, str(src), f"file://{tmp_path}/every", 7, overwrite=True).where("path is not null").collect()}
    assert more == {"N45E007.DAT.gz", "N46E007.DAT", "N47E007.DAT.gz"}
    for b in (good[0], wrong):
        assert (binascii.crc_hqx(b[:16] + b"\0\0" + b[18:1821], 0) == int.from_bytes(b[16:18], "little")) == (b == good[0])


def test_errors_of_files(spark, faulty):
    checked = files.stored_checks(spark, str(faulty[0]), 100)
    got = {r.tile_lat: r for r in audit.check_tiles(checked, 100).collect()}
    # bad blocks, a bad count and a bad extent; a bad size is an error, and its count of no blocks another one
    assert {k: r.errors for k, r in got.items()} == {45: 3, 46: 2, 47: 3, 48: 2, 49: 1, 50: 0}
    assert [(got[k].unread, got[k].bad_size, got[k].blocks) for k in (45, 48, 49, 50)] == [(False, False, 4), (False, True, 0), (True, False, 0), (False, False, 0)]
    assert (got[45].first_bad, got[45].reason, got[47].reason) == (1, "crc", "zero_header") and got[48].reason is None


HOSTILE = {
    '<a href="a&amp;b">x</a><A HREF=c&#100;>y</A>': ["a&b", "cd"],
    '<a href="one">1<a href="two">2</a></a>': ["two"],
    '<a href="one"><b>Parent Directory</b></a><a href="two" title="Parent Directory">x</a>': ["two"],
    '<!-- <a href="no">n</a> --><a href="yes">y</a>': ["yes"],
    '<script>"<a href=\'no\'>n</a>"</script><a href=yes>y</a>': ["yes"],
    '<a href="open">never closed <p> <a name=x>n</a>': ["open"],
    '<a href>v</a><a href="">e</a><a data-href="d">d</a>': [None],
    '<a href="x" href="y">two</a></a></a>': ["y"],
    '<a\nclass=q\thref = \'sp ace\' >s</a\n>': ["sp ace"],
    '<area href="no"><abbr href="no">n</abbr><a href="un': [],
    '<a href="p">Parent &#68;irectory</a>': [],
    "": [],
}


def test_hostile_listings(spark):
    pages = list(HOSTILE) + [None]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    got = {i: [] for i in range(len(pages))}
    for r in files.listing_links(df, "id", "html").orderBy("id", "pos").collect():
        got[r.id].append(r.href)
    assert [got[i] for i in range(len(pages))] == [*HOSTILE.values(), []]


def test_catalogues_of_folders(spark, tmp_path):
    for name in ("Eurasia/N45E007.hgt.zip", "Africa/N45E007.hgt.zip", "Africa/S01W002.hgt.zip", "Africa/README", "N10E010.hgt.zip", "Africa/N45E007.hgt.zip.bak"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    nested = {(r.tile_lat, r.tile_lon): (r.continent, r.filename) for r in files.build_catalogue(spark, str(tmp_path), nested=True).collect()}
    assert nested == {(45, 7): ("Eurasia", "N45E007.hgt.zip"), (-1, -2): ("Africa", "S01W002.hgt.zip"), (10, 10): (tmp_path.name, "N10E010.hgt.zip")}
    assert {r.continent for r in files.build_catalogue(spark, str(tmp_path)).collect()} == {"/"}
    assert files.store_size(spark, str(tmp_path)).first().bytes == 30
    lines = spark.createDataFrame([("N45E007",), (" s01w002.hgt # note",), ("# N01E001",), ("",), ("N4E007",), ("N45E007",)], "value string")
    tiles, rejects = files.read_tile_list(lines)
    assert {tuple(r) for r in tiles.collect()} == {(45, 7), (-1, -2)} and [r.line for r in rejects.collect()] == ["N4E007"]
