import functools
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from sparkdem.llm import mixing, registry

TOKENS = {"a": 900, "b": 90, None: 10, "none": 0}


def test_exponents():
    a = mixing.bisect_exponent(TOKENS, target_entropy=0.8)
    assert mixing.entropy(mixing.tempered(TOKENS, a)) == pytest.approx(0.8)
    b = mixing.bisect_exponent(TOKENS, max_repeats=3.0)
    passes = mixing.repetitions(TOKENS, mixing.tempered(TOKENS, b), None)
    assert max(passes.values()) == pytest.approx(3.0) and min(passes.values()) == pytest.approx(1.0)
    assert b == pytest.approx(1 - math.log(3) / math.log(90))
    assert mixing.bisect_exponent(TOKENS, target_entropy=9.0) == 0.0 and mixing.bisect_exponent(TOKENS) == 1.0
    assert mixing.bisect_exponent(TOKENS, max_repeats=1000.0) == 0.0
    assert mixing.bisect_exponent(TOKENS, target_entropy=0.8, max_repeats=3.0) == pytest.approx(max(a, b))
    assert mixing.bisect_exponent({"a": 0}, max_repeats=2.0) == 1.0


@pytest.mark.parametrize("budget", [None, 500.0, 20_000.0])
def test_draws_against_the_plan(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 150)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", 1 + i * 7 % 13) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, source string, n long")
    drawn = mixing.mix(df, "k", max_repeats=2.5, budget=budget).collect()
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in {r[1] for r in rows}}
    passes = mixing.repetitions(tokens, mixing.tempered(tokens, mixing.bisect_exponent(tokens, max_repeats=2.5, budget=budget)), budget)
    for s, p in passes.items():
        mine = [r for r in drawn if r.source == s]
        blocks = {r.block for r in mine} or {0}
        assert p * tokens[s] - 14 * max(1, len(blocks)) - 14 * (2000 // 150 + 1) <= sum(r.tokens for r in mine) <= p * tokens[s] + 1
        times = {k: 0 for k, x, _ in rows if x == s}
        for r in mine:
            times[r.key] += 1
        assert set(times.values()) <= {math.floor(p + 1e-9), math.floor(p + 1e-9) + 1}
        for key in {(r.block, r.pass_no) for r in mine}:
            spots = sorted(r.position for r in mine if (r.block, r.pass_no) == key)
            assert spots == list(range(1, len(spots) + 1))
    assert sorted(map(tuple, drawn), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7), "k", max_repeats=2.5, budget=budget).collect()), key=str)


def test_query_keeps_every_document(spark):
    rows = registry.op9_mixing(spark, "/root/testdata/sf0.01").collect()
    ids = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == ids and len(rows) > len(ids)


def test_edge_rows(docs, no_docs):
    n = docs.withColumnRenamed("size", "size2").selectExpr("*", "size(split(text, ' ')) as n")
    drawn = mixing.mix(n, "doc_id", max_repeats=2.0)
    out = mixing.mix_rows(docs, drawn, "doc_id")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    empty = no_docs.selectExpr("doc_id", "source", "1 as n")
    assert mixing.mix(empty, "doc_id", max_repeats=2.0).collect() == []
    assert mixing.mix(docs.selectExpr("doc_id", "source", "cast(null as long) as n"), "doc_id", max_repeats=2.0).count() == docs.select("doc_id").distinct().count()


def drawn_plainly(rows, most, per_block=2000):
    """The draws of rows (key, source, tokens), from the definition: with one pass over the largest source, the share to the
    power a gives each other one (largest / own) ** (1 - a) passes, so the limit gives a outright."""
    keys = {}
    for key, source, n in rows:
        s, total = keys.get(key, (source, 0))
        least = source if s is None else s if source is None else min(s, source)
        keys[key] = (least, total + max(0, n or 0))
    tokens = Counter()
    for s, n in keys.values():
        tokens[s] += n
    some = [n for n in tokens.values() if n]
    a = min(1.0, max(0.0, 1 - math.log(most) / math.log(max(some) / min(some)))) if some and max(some) > min(some) else 0.0
    hashed = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of = lambda k: [] if k is None else [struct.pack("<q", k)]
    blocks, out = defaultdict(list), set()
    for key, (s, n) in keys.items():
        count = max(1, -(-sum(x == s for x, _ in keys.values()) // per_block))
        blocks[s, signed(hashed(*of(key), struct.pack("<i", 0))) % count].append((key, n))
    for (s, block), mine in blocks.items():
        passes = (max(some) / tokens[s]) ** (1 - a) if tokens[s] else 1.0
        for number in range(math.floor(passes + 1e-9) + 1):
            left = None if number < math.floor(passes + 1e-9) else math.floor(sum(n for _, n in mine) * (passes - number) + 1e-6)
            order = sorted(mine, key=lambda r: (signed(hashed(*of(r[0]), struct.pack("<i", number), struct.pack("<i", 1))), r[0] is not None, r[0] or 0))
            spent = 0
            for position, (key, n) in enumerate(order, 1):
                spent += n
                if left is None or (left > 0 and spent <= left):
                    out.add((key, s, block, number, position, n))
    return out


@pytest.mark.parametrize("most", [1.25, 2.0])
def test_draws_against_the_definition(spark, docs, monkeypatch, most):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 150)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = [(r.doc_id, r.source, len(re.findall(r"\S+", r.text or "", re.ASCII))) for r in table.collect()]
    odd = [(None, None, 3), (1, "zz", 2), (10**12, None, None), (10**12 + 1, "none", 0)]
    df = spark.createDataFrame(counted + odd, "doc_id long, source string, n long").repartition(5)
    got = mixing.mix(df, "doc_id", max_repeats=most).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == drawn_plainly(counted + odd, most, 150)
