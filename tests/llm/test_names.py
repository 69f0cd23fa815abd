"""Columns whose names clash with those that the operators add."""

import pytest

from sparkdem.llm import mixing, sharding, simhash

CLASHING = "doc_id long, text string, source string, row int, id int, t int, kept_id int, n int, own_key int, drawn_key int, times int, col int, `to` int, `at` int, shard int, SLOT int, own_id int, placed_id int, __keep int, __key int, `a.b` int"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"some words of text {i // 2 * 2}", "ab"[i % 2], *([7] * 18)) for i in range(6)] + [(None, None, None, *([None] * 18))]
    return spark.createDataFrame(data, CLASHING)


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_representatives(rows, similarity):
    kept = simhash.keep_representatives(rows, similarity=similarity)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["a.b"]) for r in kept.collect()) == [(False, 0, None), (True, 0, 7), (True, 2, 7), (True, 4, 7)]


def test_mixed_rows(spark, rows):
    drawn = spark.createDataFrame([(0, 1), (0, 2), (3, 1), (None, 1)], "key long, pass_no int")
    out = mixing.mix_rows(rows, drawn, "doc_id")
    assert out.columns == rows.columns and sorted((r.doc_id is not None, r.doc_id or 0, r.times) for r in out.collect()) == [(False, 0, None), (True, 0, 7), (True, 0, 7), (True, 3, 7)]


def test_written_shards(spark, rows, tmp_path):
    assigned = sharding.shard_documents(rows, 3)
    for df, names in ((rows, ("shard_", "slot_")), (rows.drop("shard", "SLOT"), ("shard", "slot"))):
        path = str(tmp_path / names[0])
        sharding.write_shards(df, assigned, path)
        back = spark.read.parquet(path)
        assert set(back.columns) == {*df.columns, *names} and back.count() == 7
        want = {(r.doc_id, r.shard, r.slot) for r in assigned.collect()}
        assert {(r.doc_id, r[names[0]], r[names[1]]) for r in back.collect()} == want
        for part in back.select(*names).distinct().groupBy(names[0]).count().collect():
            assert part["count"] == sum(s == part[names[0]] for _, s, _ in want)
    sharding.write_shards(rows.where("false"), assigned, str(tmp_path / "none"))
