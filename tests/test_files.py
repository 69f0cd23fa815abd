"""Files written by an encoder of the tests' own, read and written by the library; streams; the reference cases of requests."""

import gzip
import io
import struct
import uuid
import zipfile
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdem.functions import codec, geo
from sparkdem.operators import audit, grid, requests, sampling
from sparkdem.sources import files
from sparkdem.streaming import jobs


def crc(data):
    """CRC-16 of polynomial 0x1021, a bit at a time."""
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ (0x1021 if c & 0x8000 else 0)) & 0xFFFF
    return c


def block(lat, lon, gx, gy, heights, tile=(45, 7), version=1, spacing=100, bitmap=(1 << 56) - 1, minor=1):
    head = lambda c: struct.pack("<QiiHHH", bitmap, lat, lon, c, version, spacing)
    body = struct.pack("<896h", *heights) + struct.pack("<HHhb", gx, gy, tile[1], tile[0])
    return (head(crc(head(0) + body)) + body + bytes([minor])).ljust(2048, b"\0")


@pytest.fixture
def dat_dir(tmp_path):
    flat = [100] * 896
    good = [block(450_000_000, 70_000_000 + i, 0, i, flat) for i in range(3)]
    bad = bytearray(block(450_000_000, 70_000_003, 0, 3, flat))
    bad[500] ^= 1
    cases = {"N45E007.DAT": b"".join(good) + bytes(bad), "N46E007.DAT": b"".join(good)[:-227], "N47E007.DAT": good[0] + bytes(2048) + good[2]}
    for name, data in cases.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    (tmp_path / "N48E007.DAT.gz").write_bytes(gzip.compress(good[0])[:-20])
    return str(tmp_path)


def test_read_and_check_dat(spark, dat_dir):
    rows = files.read_dat(spark, dat_dir).withColumns({"tile_lat": F.col("lat_degrees"), "tile_lon": F.col("lon_degrees")})
    got = {(r.path[-14:-7], r.blocknum): r for r in audit.check_blocks(rows, 100, with_crc=True).collect()}
    assert got["N48E007", None].error and got["N45E007", 0].heights == [100] * 896
    reasons = {k: r.reason for k, r in got.items() if r.error is None}
    assert reasons == {("N45E007", i): None for i in range(3)} | {("N45E007", 3): "crc"} | {("N46E007", i): None for i in range(3)} | {("N47E007", 0): None, ("N47E007", 1): "zero_header", ("N47E007", 2): None}
    assert got["N46E007", 0].file_bytes == 3 * 2048 - 227
    assert [tuple(r) for r in files.scan_tiles(spark, dat_dir).collect()] == [(45, 7), (46, 7), (47, 7), (48, 7)]
    assert files.store_size(spark, dat_dir).first().bytes > 0


def test_blocks_survive_writing_and_bundling(spark, tmp_path):
    heights = np.random.default_rng(1).integers(-100, 4000, 896).tolist()
    raw = [block(450_000_000, 70_000_000, 0, 0, heights), bytes(2048), block(450_000_100, 70_000_000, 1, 0, heights[::-1])]
    src = tmp_path / "src"
    src.mkdir()
    (src / "N45E007.DAT.gz").write_bytes(gzip.compress(b"".join(raw)))
    blocks = files.read_dat(spark, str(src)).where("version = 1")
    out = files.write_dat(blocks, f"{tmp_path}/out").collect()
    assert [(r.name, r.bytes) for r in out] == [("N45E007.DAT", 3 * 2048)]
    data = (tmp_path / "out" / "N45E007.DAT.gz").read_bytes()
    assert gzip.decompress(data) == b"".join(raw) and b"N45E007.DAT\0" in data[:40]
    assert [bytes(r.content) for r in grid.pack_blocks(blocks.drop("content", "path", "file_bytes", "error")).orderBy("blocknum").collect()] == [raw[0], raw[2]]
    members = spark.createDataFrame([("a", out[0].path), ("b", out[0].path), ("b", f"{tmp_path}/out/missing.DAT.gz")], "request string, path string")
    done = {r.key: r for r in files.write_bundle(members, "request", f"{tmp_path}/zips").collect()}
    assert done["a"].status == "ok" and done["b"].status.startswith("failed")
    with zipfile.ZipFile(done["a"].path) as z:
        assert z.namelist() == ["N45E007.DAT"] and z.read("N45E007.DAT") == b"".join(raw)


def test_rasters_survive_reading_and_writing(spark, tmp_path):
    raster = np.random.default_rng(2).integers(-500, 5000, (1201, 1201)).astype(">i2")

    def zipped(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, m in enumerate(members):
                z.writestr(f"{i}.hgt", m)
        return out.getvalue()

    src = tmp_path / "src"
    src.mkdir()
    (src / "S05W003.hgt.zip").write_bytes(zipped(raster.tobytes()))
    (src / "N00E001.hgt.zip").write_bytes(zipped(raster.tobytes(), b"x"))
    (src / "N00E002.hgt.zip").write_bytes(zipped(raster.tobytes()[:-2]))
    rows = files.read_hgt(spark, str(src), "*.hgt.zip").cache()
    assert rows.where("error is not null").count() == 2
    good = rows.where("error is null")
    south = good.where("y = 0").first()
    assert (south.tile_lat, south.tile_lon, south["size"], south.h) == (-5, -3, 1201, raster[-1].tolist())
    (written,) = files.write_hgt(good, f"{tmp_path}/out").collect()
    with zipfile.ZipFile(written.path) as z:
        assert z.read("S05W003.hgt") == raster.tobytes()
    cat = files.build_catalogue(spark, str(src)).collect()
    assert {(r.tile_lat, r.tile_lon, r.continent) for r in cat} == {(-5, -3, "/"), (0, 1, "/"), (0, 2, "/")}


def test_bulk_generation_agrees_with_sampling_each_point(spark):
    rng = np.random.default_rng(3)
    rows = [(a, o, 25, y, rng.integers(-50, 4000, 25).tolist()) for a in (45, 46) for o in (7, 8) for y in range(25)]
    hgt = spark.createDataFrame(rows, "tile_lat int, tile_lon int, size int, y int, h array<smallint>")
    tile = spark.createDataFrame([(45, 7)], "tile_lat int, tile_lon int")
    made = grid.generate_blocks(hgt, tile, 1000)
    cells = made.select("blocknum", F.posexplode("heights").alias("i", "h"))
    points = grid.grid_points(grid.enumerate_blocks(tile, 1000), 1000)
    want = sampling.sample_hgt(points, hgt).select("blocknum", (F.col("gx") * 32 + F.col("gy")).alias("i"), "height")
    both = cells.join(want, ["blocknum", "i"])
    assert both.count() == cells.count() > 0 and both.where("h <> height").count() == 0
    files_in = files.BLOCKS_OUT.split(", ")
    assert {c.split()[0] for c in files_in} >= set(grid.with_header(made).columns)


def test_flat_and_void_planes():
    gx, gy = np.array([0, 1]), np.array([0, 2])
    for value, want in ((100, 100), (geo.VOID, -1)):
        rasters = {(a, o): np.full((25, 25), value, np.int16) for a in (45, 46) for o in (7, 8)}
        assert set(codec.interpolate_tile(rasters, 45, 7, gx, gy, 1000).ravel()) == {want}
    assert set(codec.interpolate_tile({}, 45, 7, gx, gy, 1000).ravel()) == {0}


def test_native_store(spark, tmp_path):
    tiles = spark.createDataFrame([(45, 7), (46, 7)], "tile_lat int, tile_lon int")
    ocean = grid.generate_ocean(tiles, tiles.where("false"), 5000)
    files.write_blocks(ocean, f"{tmp_path}/store")
    back = spark.read.parquet(f"{tmp_path}/store")
    assert back.where("spacing = 5000").count() == ocean.count() > 0


def test_checksum_of_a_known_text(spark):
    assert spark.createDataFrame([(b"123456789",), (None,)], "b binary").select(codec.crc16_xmodem("b")).collect() == [(0x31C3,), (None,)]


REQUESTS = [
    (1, None, None, None, None), (2, "-35.363261", "149.165230", None, "1"), (3, "I am bad data", "echo test", "1", "1"), (4, "206.56", "-400", "1", "3"),
    (5, "60.363261", "167.16523", "1", "1"), (6, "-35.363261", "149.16523", "1", "3"), (7, "-83.363261", "149.16523", "100", "3"), (8, "-44.5234", "171.00197", "1", "3"), (9, "-30.363261", "137.165230", "100", "3"),
]
REQUEST = "request_id int, lat string, lon string, radius string, version string"


def test_known_requests(spark):
    v = requests.validate_requests(spark.createDataFrame(REQUESTS, REQUEST))
    assert {r.request_id for r in v.where("status = 'ok'").collect()} == {5, 6, 7, 8, 9}
    cover = requests.cover_requests(v).collect()
    tiles = {i: {(r.tile_lat, r.tile_lon) for r in cover if r.request_id == i} for i in range(5, 10)}
    assert tiles[5] == {(60, 167)} and tiles[6] == {(-36, 149)} and {(-45, 171), (-45, 170)} <= tiles[8] and len(tiles[9]) == 9
    inside = {(r.tile_lat, r.tile_lon) for r in cover if r.request_id == 7 and not r.outside}
    assert inside == {(-84, o) for o in range(141, 158)} | {(-83, o) for o in range(141, 157)}


def test_streams_give_what_batches_give(spark, tmp_path):
    src, name = tmp_path / "in", f"t{uuid.uuid4().hex}"
    spark.createDataFrame(REQUESTS, REQUEST).write.parquet(str(src))
    stream = jobs.stream_cover(spark.readStream.schema(REQUEST).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table(name).collect()) == sorted(jobs.stream_cover(spark.read.parquet(str(src))).collect())
    log = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 05:00:00"), (2, "2026-01-01 06:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    kept = jobs.drop_repeats(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "log")))
    q = kept.writeStream.format("memory").queryName(name + "r").option("checkpointLocation", str(tmp_path / "r")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.user_id for r in spark.table(name + "r").collect()) == [1, 2]


def test_ingest_reads_each_file_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"N0{n}E001.DAT.gz").write_bytes(b"x" * n)
        jobs.stream_ingest(spark, str(tmp_path / "in"), "*.DAT.gz", lambda df, i: seen.extend(r.length for r in df.select("length").collect()), str(tmp_path / "c")).awaitTermination()
    assert seen == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.integers(-60, 60), st.floats(0, 80_000), st.floats(0, 80_000))
def test_offsets_come_back(lat, north, east):
    """The column formulas in plain Python: an offset and the distance back agree within a unit of e7."""
    dlat = int(north * geo.E7_PER_M)
    scale = codec.scale_of(np.array([(lat * 1e7 + dlat * 0.5) * 1e-7]))[0]
    dlon = int(east * geo.E7_PER_M / scale)
    assert abs(dlat * geo.M_PER_E7 - north) < 0.02 and abs(dlon * scale * geo.M_PER_E7 - east) < 0.02


class Anchors(HTMLParser):
    """Links with their texts, as an HTML parser reads them."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.found.append([dict(attrs)["href"], ""])

    def handle_data(self, data):
        if self.found:
            self.found[-1][1] += data


def test_links_of_any_case_and_quotes(spark):
    pages = [
        (1, "<A HREF=\"N45E007.hgt.zip\">one</A> <a class='x' href='S01W002.hgt.zip'\n title=\"y\">two</a>"),
        (2, "<a data-href=\"no\" href=Eurasia/>Eurasia</a><a href=\"../\">Parent Directory</a><a href='README'>r</a><a name=x>none</a><a href=\"?C=N\">s</a>"),
        (3, None),
    ]
    df = spark.createDataFrame(pages, "id long, html string")
    want = []
    for i, html in pages:
        parser = Anchors()
        parser.feed(html or "")
        want += [(i, h) for h, t in parser.found if "Parent Directory" not in t]
    got = [(r.id, r.href) for r in files.listing_links(df, "id", "html").orderBy("id", "pos").collect()]
    assert got == want and len(want) == 5
    assert [r.href for r in files.listing_folders(df, "id", "html").orderBy("id", "pos").collect()] == ["N45E007.hgt.zip", "S01W002.hgt.zip", "Eurasia/"]
    found = files.listing_to_catalogue(df, "id", "html", "Eurasia").collect()
    assert sorted((r.tile_lat, r.tile_lon, r.continent, r.filename) for r in found) == [(-1, -2, "Eurasia", "S01W002.hgt.zip"), (45, 7, "Eurasia", "N45E007.hgt.zip")]


def test_requests_outside_stay(spark):
    cover = spark.createDataFrame([(1, 85, 0, True), (1, 86, 0, True), (2, 84, 0, False), (2, 85, 0, True), (3, 10, 0, False), (3, 11, 0, False)], "request_id long, tile_lat int, tile_lon int, outside boolean")
    store = spark.createDataFrame([(84, 0), (10, 0)], "tile_lat int, tile_lon int")
    got = {tuple(r) for r in requests.resolve_requests(cover, store).collect()}
    assert got == {(1, 0, 2, "ok"), (2, 1, 1, "ok"), (3, 2, 0, "Cannot generate terrain")}


def test_bad_rasters_beside_good_ones(spark):
    """An error row doesn't stop the job: the raster is ocean, or its tile is skipped."""
    rows = [(45, 7, 25, y, [100] * 25) for y in range(25)] + [(45, 8, None, None, None), (None, None, None, None, None)]
    rasters = spark.createDataFrame(rows, "tile_lat int, tile_lon int, size int, y int, h array<smallint>")
    tiles = spark.createDataFrame([(45, 7), (45, 8)], "tile_lat int, tile_lon int")
    ocean = {(r.tile_lon, r.blocknum): r.heights for r in grid.generate_blocks(rasters, tiles, 3000).collect()}
    skipped = {(r.tile_lon, r.blocknum): r.heights for r in grid.generate_blocks(rasters, tiles, 3000, "skip").collect()}
    assert {k[0] for k in ocean} == {7, 8} and {k[0] for k in skipped} == {7}
    assert all(ocean[k] == v for k, v in skipped.items()) and all(set(v) == {0} for k, v in ocean.items() if k[0] == 8) and ocean[7, 0][0] == 100


def test_no_exchange_of_the_raster_and_of_cells(spark, tmp_path):
    """Few points: the raster table is filtered where it is read. A mosaic: no shuffle stands above the cells' explosion."""
    rasters = spark.range(500).selectExpr("cast(id div 25 as int) tile_lat", "0 tile_lon", "25 size", "cast(id % 25 as int) y", "transform(sequence(0, 24), i -> cast(id + i as smallint)) h")
    rasters.write.parquet(str(tmp_path / "r"))
    points = spark.createDataFrame([(1, 15_000_000, 4_000_000), (2, 250_000_000, 1)], "id long, lat_e7 long, lon_e7 long")
    out = sampling.sample_hgt(points, spark.read.parquet(str(tmp_path / "r")))
    assert {r.id: r.height for r in out.collect()} == {1: int(25 + 12 + 9.6), 2: 0}
    blocks = spark.range(4).selectExpr("0 tile_lat", "0 tile_lon", "id blocknum", "id div 2 grid_idx_x", "id % 2 grid_idx_y", "array_repeat(cast(id as smallint), 896) heights")
    cells = grid.mosaic(blocks)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Aggregate")
    got = {(r.row, r.col): r.h for r in cells.collect()}
    assert len(got) == 52 * 60 and all(h == (row >= 24) * 2 + (col >= 28) for (row, col), h in got.items())
