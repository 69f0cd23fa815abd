"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdem.llm import negatives
from sparkdem.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, score double, cell int, block string, v string"


def brute(rows, every, k=5, band=(80, 100)):
    """The definition, over all pairs, in Python's whole numbers."""
    fine = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, label, v) for i, label, v in fine if len(v) == max(map(len, (r[2] for r in fine)), default=0)]
    out = set()
    for i, label, a in {(i, label, tuple(v)) for i, label, v in fine if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, own) for j, own, v in fine if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            found = [x for x in scored if x[2] != label and band[0] * -s <= -100 * x[0] <= band[1] * -s][:k]
            out |= {(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(found, 1)}
    return out


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, 0.5, 1, "b", "v") for r in rows], SCHEMA).repartition(3)
    found = negatives.mine(df, lambda i: i % every == 0, **options)
    return [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


@pytest.mark.parametrize("sizes", [(64, 2048, 8192), (5, 3, 40), (16, 1, 7)])
def test_all_pairs(spark, monkeypatch, sizes):
    for name, n in zip(("PIVOTS", "GROUP_ANCHORS", "BLOCK_ROWS"), sizes):
        monkeypatch.setattr(negatives, name, n)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[rng.integers(6)] + 0.4 * rng.normal(size=8)).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(400 + i, rows[17][1], i % 4) for i in range(200)]  # a third are copies of one vector
    got = mined(spark, rows, 10)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10) and len(got) > 500


def test_clusters_are_sent_to_few_groups(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 4)
    rng, sent = np.random.default_rng(2), []
    rows = [(i, (20 * np.eye(8)[i % 8] + 0.1 * rng.normal(size=8)).tolist(), i % 16 // 8) for i in range(640)]
    joined = negatives.joined
    monkeypatch.setattr(negatives, "joined", lambda a, c, *rest: (sent.append((c.count(), c.select("group").distinct().count())), joined(a, c, *rest))[1])
    assert set(mined(spark, rows, 10)) == brute(rows, 10)
    assert all(n < 640 * groups / 3 and groups >= 8 for n, groups in sent)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (10, None, 1), (20, [0.0, 0.0], 1), (30, [nan, 1.0], 1), (40, [1.0, inf], 0), (50, [None, 1.0], 0), (None, [1.0, 1.0], 1),
        (60, [1.0, 0.5], None), (70, [], 1), (1, [0.9, 0.1], 1), (2, [0.9, 0.1], 1), (3, [0.8, 0.1], 0), (3, [0.8, 0.1], 0), (4, [0.9, 0.0], 0),
        (0, [1.0, 0.0], 1), (0, [0.5, 0.5], 0), (5, [-1.0, 0.0], 2), (6, [3.0, 1.0], 2), (7, [0.001, 0.999], 2), (8, [1.0, 2.0, 3.0], 1),
    ]
    two = [r for r in rows if not r[1] or len(r[1]) == 2]
    got = mined(spark, rows, 10)
    # equal rows are candidates each, and have a rank each
    assert set(got) == brute(two, 10) and got


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 1e6 + 3e6).tolist(), i % 2) for i in range(60)]
    assert set(mined(spark, rows, 10)) == brute(rows, 10)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(10, [1.0], 1)], [(10, None, None)], [(10, [1.0], 1), (11, [1.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert mined(spark, rows, 10) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in QUERIES["op12_negatives"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 100)
