import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkdem.llm import lines, simhash
from sparkdem.llm.common import materialise, scratch, shared_dir

ROWS = [(i, f"line {i % 7} of a few that are in many of the documents, long enough to be signed, and said again\nown line of {i}: {i * 7919}") for i in range(60)]


@pytest.fixture
def written(spark):
    """The names of tables that were written to the shared folder since the test began."""
    folder = shared_dir(spark).removeprefix("file://")
    tables = lambda: {d for d in os.listdir(folder) if "-" in d and os.path.exists(f"{folder}/{d}/_SUCCESS")}
    before = tables()
    return lambda: sorted(d.rpartition("-")[0] for d in tables() - before)


def test_tables_go_but_for_those_kept(spark, written):
    with scratch(spark) as outer:
        with scratch(spark) as kept:
            a, b = materialise(spark.range(5), "a"), materialise(spark.range(6), "b")
            both = kept(a.select(F.col("id") + 1).unionByName(a.select(F.col("id") + 1)))
            b.count()
        assert written() == ["a"] and both.count() == 10
        c = outer(materialise(both, "c"))
    assert written() == ["c"] and c.count() == 10
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialise(spark.range(5), "d").select(1 // 0)
    assert written() == ["c"]


def test_stages_leave_what_they_read_only(spark, written):
    """All that they had written stayed on the disk, for all stages of a run."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = lines.drop_duplicate_lines(df)
    assert written() == ["gone"] and out.count() == 60
    found = lines.line_components(df)
    assert written() == ["classes", "edges", "gone", "lines"] and found.where("kept").count() == 61
    few = simhash.keep_representatives(df, words=corpus_pipeline.WORDS, similarity=corpus_pipeline.SIMILARITY)
    assert written() == ["classes", "edges", "gone", "kept", "lines"] and few.count() > 0
