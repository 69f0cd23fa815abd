import random

from pyspark.sql import functions as F

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_takes_copies_at_a_similarity_of_0_8(spark):
    """All pairs, compared by brute force: copies with words changed have Jaccard similarities on both sides of 0.8."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        rows.append((10 * base, " ".join(text)))
        for copy in range(1, 4):
            other = list(text)
            for i in rng.sample(range(len(text)), max(1, len(text) * rng.choice([5, 10, 18, 22, 40]) // 1000)):
                other[i] = rng.choice(words)
            rows.append((10 * base + copy, " ".join(other)))
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    alike = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for a, b in alike:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {d for d in root if find(d) == d}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id for r in corpus_pipeline.near_duplicates_go(spark, docs, "").collect()}
    assert len(alike) > 60 and 60 <= len(want) < len(rows)
    assert got == want
