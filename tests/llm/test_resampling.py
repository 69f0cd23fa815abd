"""Importance resampling against counting word by word, and its query against SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkdem.llm import resampling
from sparkdem.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run=1):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, run, least, share):
    """(doc_id, n_features, weight, score, rank) of each of (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, run)[1]), Counter(bucket(f) for x in target for f in features(x, run)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, able = [], 0
    for i, x in docs:
        n, f = features(x, run)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
        able += n >= least
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(best[: share(able)], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def resampled(docs, target, **options):
    found = resampling.resample(docs, target, **options).select("id", "n_features", "weight", "score", "rank")
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("run,buckets,least,chars", [(1, 10_000, 20, 300), (2, 97, 0, 4_000_000), (3, 1, 2, 300)])
def test_odd_rows(spark, docs, monkeypatch, run, buckets, least, chars):
    monkeypatch.setattr(resampling, "CHARS_IN_BLOCK", chars)
    target = spark.createDataFrame([("The cat, the CAT",), (None,), ("",), ("x² 中文 émoji",)], "text string")
    rows, share = [(r.doc_id, r.text) for r in docs.collect()], lambda n: n // 2
    got = resampled(docs, target, share=share, buckets=buckets, run=run, min_words=least)
    assert got == brute(rows, [r.text for r in target.collect()], buckets, run, least, share)


def test_ties_and_repeated_rows(spark):
    # a third of all rows are one, and share their score
    docs = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("one two three").alias("text"), F.lit(1).alias("score"), F.lit("x").alias("block"))
    target = spark.createDataFrame([("two",)], "text string")
    share = lambda n: 9 * n // 10
    got = resampled(docs, target, share=share, min_words=3)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], ["two"], 10_000, 1, 3, share)


@pytest.mark.parametrize("share", [0, 1, 5])
def test_no_rows(spark, docs, no_docs, share):
    none = spark.createDataFrame([], "text string")
    assert not resampled(no_docs, none, share=lambda n: share)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert resampled(docs, none, share=lambda n: min(n, share), min_words=1) == brute(rows, [], 10_000, 1, 1, lambda n: min(n, share))


def test_the_matrix_is_in_compressed_rows(spark):
    df = spark.createDataFrame([(5, "b a b"), (6, ""), (7, "a")], "doc_id long, text string").coalesce(1)
    (r,) = resampling.matrix(df, 50).collect()
    entries = {zlib.crc32(b"a") % 50: 1, zlib.crc32(b"b") % 50: 2}
    number = lambda x: [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)]
    assert (r.ids, r.words, r.features, r.starts) == ([5, 6, 7], [3, 0, 1], [3, 0, 1], [0, 2, 2, 3])
    assert dict(zip(number(r.buckets)[:2], number(r.counts)[:2])) == entries and number(r.buckets)[2:] == [zlib.crc32(b"a") % 50]


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLES["op13_resampling"])
    got = QUERIES["op13_resampling"](spark, sf)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, 10_000, 1, 20, lambda n: 10 * n // 100)
