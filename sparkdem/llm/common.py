"""Shared helpers: tables, the shared folder, materialised tables, Arrow map stages and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    jsc = spark.sparkContext._jsc.sc()
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Session setting under which a statement's shuffle files go when it ends; what is written no longer needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Session setting of the size up to which Spark broadcasts a side on its own, and that size while a table is written. Spark sizes
#: a side by its file and takes no rows of an explode into account, so 10 MB by its count may be hundreds in the driver.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_BYTES = 256 << 10


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings inside, and those before it again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few_broadcasts(spark: SparkSession) -> dict[str, str]:
    """The setting under which Spark broadcasts BROADCAST_BYTES by its own count at most; a lower one stays. Sides that are counted
    (held) or bounded are broadcast as they ask."""
    asked = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return {BROADCAST: str(min(asked, BROADCAST_BYTES))}


def materialise(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _scratch[-1:]:
        paths.append(path)
    with settings(spark, {CLEANUP: "true"} | few_broadcasts(spark)):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written in each `scratch` that is open, the innermost last.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside (materialise) are deleted when it ends, so the disk holds those of one step only. It gives
    a function: what a frame given to that reads is kept, for the `scratch` around it, if there is one. Frames that are
    used after it must be given to it, or read nothing that was written inside."""
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        files = "\n".join(df.inputFiles())
        read = [p for p in paths if f"/{p.rpartition('/')[2]}/" in files]
        paths[:] = [p for p in paths if p not in read]
        for around in _scratch[-2:-1]:
            around.extend(read)
        return df

    _scratch.append(paths)
    try:
        yield kept
    finally:
        _scratch.pop()
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def carried(df: DataFrame, *keys: Column) -> DataFrame:
    """The keys, and row, a struct of all of df's columns: so no name of theirs can clash with what is added."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *keys)


def uncarried(rows: DataFrame) -> DataFrame:
    """The columns of row again."""
    return rows.select("row.*")


#: Rows of keys that are broadcast at most: a few megabytes.
BROADCAST_ROWS = 400_000


def held(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to small, a written table of a key and few other numbers: broadcast while it has at most `most` rows, and
    shuffled beyond them."""
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small.hint("shuffle_hash"), on, how)


def hashed_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most n rows, those whose keys have the least hash. Of a large table all but about 2 * n rows are left out
    beforehand, so what is sorted and sent stays bounded however many partitions there are."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    total = df.count()
    few = df.where(place < int((1 << 40) * 2 * n / total)) if total > 4 * n else df
    return few.orderBy(place, *keys).limit(n)


#: Rows of an Arrow batch: whole texts are long, and an executor holds a batch several times on its way to a worker and back.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from an iterator of record batches to an iterator of lists of columns. Sets the session's rows
    of an Arrow batch (small_batches), which are read when the plan runs."""
    out = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    small_batches(df.sparkSession)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers live on for other stages

    return df.mapInArrow(run, out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (union-find on edges, all distributed).

    edges: columns u, v (long). Returns node, component for every node that has an edge to another node; component is
    the smallest node of its component. Nulls and self-links are ignored. Rounds go on until one changes nothing (about
    the logarithm of the number of nodes); each is written, so a lost executor costs one round at most.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, seen = materialise(e.distinct(), "edges"), None
    while (state := e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()) != seen:
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
