"""Packing against the tokenizers library, a slow solver and plain counting."""

import binascii
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkdem.llm import packing
from sparkdem.llm.registry import QUERIES, vocab_path


def used(plan, window):
    h, n = np.zeros(window + 1, np.int64), 0
    for lengths, repeats in plan:
        assert repeats > 0 and 0 < sum(lengths) <= window
        for v in lengths:
            h[v] += repeats
        n += repeats
    return h, n


@pytest.mark.parametrize("kind", ["uniform", "short", "long", "one", "few", "none", "full"])
def test_plans_use_up_the_histogram_with_little_padding(kind):
    w, rng = 256, np.random.default_rng(3)
    h = np.zeros(w + 1, np.int64)
    made = {"uniform": lambda: rng.integers(1, w + 1, 50_000), "short": lambda: rng.geometric(0.05, 50_000).clip(1, w), "long": lambda: w + 1 - rng.geometric(0.05, 3000).clip(1, w), "one": lambda: np.full(10_001, 3), "few": lambda: rng.integers(1, w + 1, 200), "none": lambda: [], "full": lambda: np.full(7, w)}[kind]()
    np.add.at(h, made, 1)
    got, n = used(packing.plan_windows(h, w), w)
    assert (got == h).all()
    total = int((h * np.arange(w + 1)).sum())
    least = max(-(-total // w), int(h[w // 2 + 1 :].sum()))  # no two pieces of over half a window share one
    assert n <= least * {"uniform": 1.01, "few": 1.05, "long": 1.01}.get(kind, 1.003) + 1


def test_combinations_are_all_that_fill_the_window():
    lengths = np.array([1, 2, 3, 5, 7, 12])
    got = sorted(map(tuple, packing.combinations(lengths, 12).tolist()))
    s = [0, *lengths.tolist()]
    want = sorted({(a, b, c) for a in s for b in s for c in s if a <= b <= c and a + b + c == 12 and (a or not b or b)})
    assert got == want


def test_counts_reach_the_least_squares():
    rng, w = np.random.default_rng(5), 24
    h = rng.integers(0, 400, w + 1)
    h[0] = 0
    combos = packing.combinations(np.flatnonzero(h), w)
    weights = np.arange(w + 1) / w + 0.1
    x = packing.solve_counts(combos, h, weights, rounds=5000, tolerance=1e-6)
    a = np.zeros((w + 1, len(combos)))
    for i, row in enumerate(combos.tolist()):
        for v in row:
            if v:
                a[v, i] += 1
    d = weights[:, None] * a
    y, slope = np.zeros(len(combos)), 1 / np.linalg.norm(d, 2) ** 2
    for _ in range(30_000):  # projected gradient, slowly
        y = np.maximum(0, y - slope * d.T @ (d @ y - weights * h))
    cost = lambda z: float(((d @ z - weights * h) ** 2).sum())
    assert (x >= 0).all() and cost(x) <= cost(y) * 1.001 + 1e-3
    g = d.T @ (d @ x - weights * h)  # the conditions of the optimum
    assert g.min() > -0.02 and abs(g[x > 1e-6]).max() < 0.02


def whole(rows, tok, docs, window):
    """Checks pieces against the library's ids; gives the number of sequences."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc, texts in docs.items():
        want = sorted((tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts))
        mine = sorted(pieces.pop(doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, want))
        if len(want) == 1:
            at = 0
            for r in mine:
                part = want[0][r.start : r.start + r.length]
                assert r.start == at and r.doc_tokens == len(want[0]) and r.ids_crc32 == binascii.crc32(np.array(part, "<u4").tobytes())
                at += r.length
    assert not pieces
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert set(seqs) == set(range(len(seqs)))
    return len(seqs)


def test_all_documents(spark):
    sf, tok = "/root/testdata/sf0.01", Tokenizer.from_file(vocab_path())
    tok.no_truncation()
    docs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        docs[r.doc_id].append(r.text)
    rows = QUERIES["op11_packing"](spark, sf).collect()
    n = whole(rows, tok, docs, 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("window", [1, 7, 1024])
def test_odd_rows(spark, docs, window):
    tok, want = Tokenizer.from_file(vocab_path()), defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(r.text)
    packed = packing.pack(docs, vocab_path(), window)
    whole(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), tok, want, window)


def test_no_rows(spark, no_docs):
    assert packing.pack(no_docs, vocab_path()).count() == 0
    assert packing.sequences(packing.pack(no_docs, vocab_path())).count() == 0


def test_sequences_are_padded(spark):
    random.seed(1)
    texts = [" ".join(random.choices("a be sea deed eels".split(), k=random.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack(df, vocab_path(), 32).cache()
    rows = packing.sequences(packed, 32, pad_id=5).collect()
    assert all(len(r.ids) == 128 for r in rows) and sum(r.filled for r in rows) == packed.agg(F.sum("length")).first()[0]
    ids = {(r.doc_id, r.start): bytes(r.ids) for r in packed.collect()}
    for r in rows:
        assert bytes(r.ids) == b"".join(ids[p.doc_id, p.start] for p in r.pieces) + (5).to_bytes(4, "little") * (32 - r.filled)
