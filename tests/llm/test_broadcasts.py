"""What Spark may broadcast on its own: sides that it sizes too low don't go through the driver."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from sparkdem.llm import common, simhash


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_are_not_broadcast(spark):
    # 2,000 fingerprints are 16 KB by Spark's count, and 68,000 variants on each side of the join
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = executed(simhash.links(prints))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_are_not_broadcast(spark):
    docs = spark.range(100).select("id", F.lit(0).cast("long").alias("t"), (F.col("id") % 7).alias("fp"))
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    named = simhash.with_components(docs, "fp", labels)
    assert "Broadcast" not in executed(named)
    assert {(r.fp, r.component_id) for r in named.collect()} == {(0, 0), (1, 0), *((k, k) for k in range(2, 7))}


def test_written_tables_broadcast_little_on_their_own(spark, monkeypatch):
    name, seen, write = "spark.sql.autoBroadcastJoinThreshold", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(name)), write(self, *a, **b))[1])
    before = spark.conf.get(name)
    common.materialise(spark.range(3))
    assert spark.conf.get(name) == before
    spark.conf.set(name, "-1")
    try:
        common.materialise(spark.range(3))
        assert spark.conf.get(name) == "-1"
    finally:
        spark.conf.set(name, before)
    assert seen == [str(256 << 10), "-1"]
