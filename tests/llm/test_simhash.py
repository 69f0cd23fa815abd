import random
import re

import xxhash
from pyspark.sql import functions as F

from sparkdem.llm import registry, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{row number: smallest id reachable} by brute force."""
    fps = sorted({f for _, f in rows})
    group = {f: {f} for f in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return [min((d for d, f in rows if f in group[fp] and d is not None), default=None) for _, fp in rows]


def test_query_against_brute_force(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in texts]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op2_simhash(spark, "/root/testdata/sf0.001").collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_edge_rows(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = sorted(((d, f, c) for (d, f), c in zip(rows, plain_components(rows))), key=str)
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_links_are_exactly_those_within_three_bits(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum({1 << rng.randrange(64) for _ in range(k)}) for k in (1, 2, 3, 4, 5)}
    base = rng.getrandbits(64)
    fps |= {base ^ (x & 255) << 20 for x in range(200)} | {0, (1 << 64) - 1}
    signed = [x - (1 << 64) * (x >> 63) for x in fps]
    got = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_one_representative_of_each_component(docs, no_docs):
    kept = simhash.keep_representatives(docs)
    found = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted(found, key=str)
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_representatives(no_docs).collect() == []
    assert simhash.keep_representatives(docs.where(F.col("doc_id").isNull())).count() == 1


def test_no_text_of_its_own_goes(spark):
    """Rows without an id, and rows that share one, are told apart by their texts."""
    rows = [(None, "one two three four"), (None, "five six seven eight"), (5, "a b c d"), (3, "a b c d"), (5, "k l m n o"), (7, "x y z"), (7, "u v w"), (7, "u v w")]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)))
    want = [(3, "a b c d"), (5, "k l m n o"), (7, "u v w"), (7, "x y z"), (None, "five six seven eight"), (None, "one two three four")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
