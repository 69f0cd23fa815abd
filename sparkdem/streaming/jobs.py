"""Incremental jobs as Structured Streaming."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkdem.functions.names import parse_tile_name
from sparkdem.operators.grid import generate_blocks, read_by, readers
from sparkdem.operators.requests import cover_requests, validate_requests
from sparkdem.sources.files import base, listed, read_hgt, store_of

TILE = ["tile_lat", "tile_lon"]


def stream_cover(requests: DataFrame) -> DataFrame:
    """Tiles of each request of a stream (or a batch): stateless, one row in, its tiles out."""
    return cover_requests(validate_requests(requests))


def drop_repeats(requests: DataFrame, time_col: str = "ts", keep: str = "24 hours", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """A repeat of a request within `keep` is dropped; the state of a key is dropped after that time."""
    return requests.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(list(keys))


def expired(files: DataFrame, now, hours: int = 24) -> DataFrame:
    """Bundles older than so many hours."""
    return files.where(F.col("modificationTime") < F.lit(now) - F.expr(f"interval {hours} hours"))


class BundleLife(StatefulProcessor):
    """The life of a request's bundle: made by the first request, it answers repeats until it expires, and then is gone."""

    def __init__(self, hours: int):
        self.life = datetime.timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "us long")

    def answers(self, key, rows: list[tuple]):
        yield pd.DataFrame(rows, columns=["ts", "answer", "made_at"]).assign(request=key[0])[["request", "ts", "answer", "made_at"]]

    def handleInputRows(self, key, rows, timerValues):
        out, life = [], int(self.life.total_seconds() * 1_000_000)
        made = self.made.get()[0] if self.made.exists() else None
        before = made
        for ts in sorted(t for batch in rows for t in batch["ts"]):
            us = pd.Timestamp(ts).value // 1000
            if made is not None and us < made + life:  # also one from before the bundle was made, if it isn't late
                out.append((ts, "repeat", pd.Timestamp(made, unit="us")))
                continue
            if made is not None:
                out.append((pd.Timestamp(made + life, unit="us"), "expired", pd.Timestamp(made, unit="us")))
            made = us
            out.append((ts, "made", ts))
        if made != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.made.update((made,))
            self.handle.registerTimer(-(-(made + life) // 1000))  # in milliseconds
        if out:
            yield from self.answers(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        made = pd.Timestamp(self.made.get()[0], unit="us")
        self.made.clear()
        yield from self.answers(key, [(made + self.life, "expired", made)])

    def close(self) -> None:
        pass


def bundle_life(requests: DataFrame, key_col: str, time_col: str = "ts", hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """request, ts, answer, made_at of a stream of requests: `made` for a request that makes a bundle, `repeat` for one that is
    answered by the bundle made at made_at, and `expired` when that is `hours` old (ts: when).

    State is a number for each request whose bundle lives, and a timer that clears it when the watermark passes the end
    of its life. Requests later than `delay` behind the watermark are dropped; null requests are one request.
    """
    rows = requests.select(F.col(key_col).cast("string").alias("request"), F.col(time_col).cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", delay)
    schema = "request string, ts timestamp, answer string, made_at timestamp"
    return rows.groupBy("request").transformWithStateInPandas(BundleLife(hours), schema, "append", "eventTime")


def stream_ingest(spark: SparkSession, path: str, pattern: str, sink, checkpoint: str):
    """Runs sink(batch of path, length, content, batch id) over the files that came since the last run, then stops."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(path)
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regenerate(spark: SparkSession, rasters: str, arrived: DataFrame, store: str, spacing: int, pattern: str = "*.hgt.zip") -> None:
    """Generates anew the blocks of the arrived tiles and of those whose blocks read them, as far as rasters of these are there,
    and puts them into the store in place of those that it has: partitions by spacing and tile, each replaced whole."""
    named = listed(spark, rasters, pattern).withColumn("tile", parse_tile_name(base(F.col("path")), "stored_hgt_zip")).where("tile is not null").select("tile.*", "path")
    catalogue = named.groupBy(*TILE).agg(F.max("path").alias("path"))  # at most 64,800 rows
    todo = readers(arrived.select(*TILE), spacing).select(F.col("for_lat").alias("tile_lat"), F.col("for_lon").alias("tile_lon")).distinct()
    todo = todo.join(F.broadcast(catalogue.select(*TILE)), TILE, "left_semi")
    read = read_by(todo, spacing)
    paths = [r.path for r in catalogue.join(read, TILE, "left_semi").select("path").collect()]  # a path a tile, at most
    if not paths:
        return
    blocks = generate_blocks(read_hgt(spark, paths, pattern).where("error is null"), todo, spacing)
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("spacing", *TILE).parquet(store)


def stream_generate(spark: SparkSession, rasters: str, store: str, spacing: int, checkpoint: str, files_at_a_time: int | None = None, pattern: str = "*.hgt.zip"):
    """Brings a store of blocks up to date with the raster files that came since the last run, then stops.

    A raster that arrives regenerates its own tile and those whose blocks reach into it (regenerate), so after
    any order of arrivals the store is what one batch over all rasters makes. A batch that has been done leaves a mark in
    the store, and does nothing if it is run again; one that was broken off replaces the same partitions again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        fs, where = store_of(store)
        mark = f"{where}/_ingested/{number}"
        if fs.get_file_info(mark).is_file:
            return
        tiles = batch.select(parse_tile_name(base(F.col("path")), "stored_hgt_zip").alias("tile")).where("tile is not null").select("tile.*").distinct()
        regenerate(spark, rasters, tiles, store, spacing, pattern)
        fs.create_dir(f"{where}/_ingested", recursive=True)
        with fs.open_output_stream(mark) as f:
            f.write(b"")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
    files = files.option("maxFilesPerTrigger", files_at_a_time) if files_at_a_time else files
    return files.load(rasters).select("path").writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
