import random
import zlib

from sparkdem.llm import registry, sharding


def held(rows, n):
    """The law: shards in order, slots gapless, bytes equal but for a row's size."""
    sizes, slots = [0] * n, [[] for _ in range(n)]
    for r in rows:
        sizes[r.shard] += r["size"] or 0
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    total = sum(sizes)
    assert all(abs(x - total / n) <= max(r["size"] or 0 for r in rows) + 1 for x in sizes), sizes


def test_query(spark):
    rows = registry.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
    held(rows, 40)


def test_skewed_and_odd_keys(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, i, rng.randrange(100)) for i in range(3000)] + [(rng.randrange(10**6), i, rng.randrange(100)) for i in range(3000)]
    rows += [(None, None, None), (7, 7, 0), (7, 7, 0), (-(2**63), 2**63 - 1, 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key long, tie long, size long, shard_name string").repartition(5)
    monkeypatch.setattr(sharding, "DRAWS", 1)  # so poor a sample that ranges come out overfull
    got = sharding.assign_shards(df, 11, 1).collect()
    assert len(got) == len(rows)
    held(got, 11)
    order = [r.key for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.key not in (7, None)]
    assert order == sorted(order)


def test_edge_tables(spark, docs, no_docs):
    assert sharding.shard_documents(no_docs).collect() == []
    rows = sharding.shard_documents(docs, 3).collect()
    assert len(rows) == docs.count()
    empty = spark.createDataFrame([(1, 1, 0), (2, 2, None)], "key long, tie long, size long")
    assert {r.shard for r in sharding.assign_shards(empty, 4).collect()} == {0}


def test_order_holds_in_overfull_ranges(spark, monkeypatch):
    """400 keys under a sample so poor that ranges are subdivided, a key of many ties, and a place of many rows."""
    monkeypatch.setattr(sharding, "DRAWS", 0.5)
    rng = random.Random(6)
    rows = [(rng.randrange(400), i, 1 + rng.randrange(60)) for i in range(4000)] + [(77, i, 20) for i in range(2000)] + [(300, 5, 30)] * 1500
    df = spark.createDataFrame(rows, "key long, tie long, size long").repartition(4)
    got = sorted(sharding.assign_shards(df, 7, 4).collect(), key=lambda r: (r.shard, r.slot))
    held(got, 7)
    assert [(r.key, r.tie) for r in got] == sorted((k, t) for k, t, _ in rows)
