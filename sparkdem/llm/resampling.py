"""Importance resampling of documents towards a target, over a persisted document-by-bucket matrix.

Words are hashed to buckets, and each batch of documents is written as a block of a sparse matrix in compressed rows:
row pointers, buckets and counts. The matrix is written once and then read twice: its column sums are the corpus's
distribution over buckets (the target's come from its own matrix), and its product with the vector of gains, a long for
each bucket, gives the documents' weights. Scores are weights with hashed Gumbel noise, so that the highest scores are a
draw without replacement, and the same on each run.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdem.llm.common import arrow_map, materialise
from sparkdem.llm.packing import binaries
from sparkdem.llm.simhash import UPPER

#: Buckets of the matrix, words in a feature's run at most, and the seed of the noise.
BUCKETS, RUN, SEED = 10_000, 1, 2024
#: Characters in a block of the matrix, about, and words whose bucket a worker remembers: bounds of memory.
CHARS_IN_BLOCK, REMEMBERED = 4_000_000, 500_000

MATRIX = "block long, ids array<long>, words array<long>, features array<long>, starts array<long>, buckets binary, counts binary"


class BucketOf(dict):
    """Feature (bytes) to bucket, remembered while they are few."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


#: What isn't part of a word becomes a space, A-Z become small letters: 0-9, a-z and all that isn't ASCII make words.
FOLD = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in UPPER)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def runs_of(words: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to `most` consecutive words, joined by one space."""
    return words if most == 1 else [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def matrix(df: DataFrame, buckets: int = BUCKETS, run: int = RUN, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """MATRIX: blocks of compressed rows, a row for each row of df, repeated ones included. A null or empty text is an empty row.

    ids, words and features (how many of them) are by row; row i has the entries starts[i] to starts[i + 1] of buckets and
    counts, which are little-endian unsigned 32-bit numbers. block tells blocks apart.
    """

    def work(batches):
        bucket_of, rows, held, chars = BucketOf(buckets), [], [], 0
        sizes: list[tuple[int, int]] = []

        def block():
            row = np.repeat(np.arange(len(rows)), [f for _, f in sizes])
            keys, counts = np.unique(row * buckets + np.concatenate(held), return_counts=True)
            starts = np.searchsorted(keys, np.arange(len(rows) + 1) * buckets)
            name = int.from_bytes(os.urandom(8), "little", signed=True)
            parts = ((keys % buckets).astype("<u4"), counts.astype("<u4"))
            return [name], [list(rows)], [[w for w, _ in sizes]], [[f for _, f in sizes]], [starts], *(binaries(x, np.array([4 * len(x)])) for x in parts)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = words_of(text)
                found = runs_of(words, run)
                held.append(np.fromiter(map(bucket_of.__getitem__, found), np.int64, len(found)))
                rows.append(name)
                sizes.append((len(words), len(found)))
                chars += len(text) + 100
                if chars > CHARS_IN_BLOCK:
                    yield block()
                    rows, held, sizes, chars = [], [], [], 0
        if rows:
            yield block()

    ident = F.lit(None) if id_col is None else F.col(id_col)
    return arrow_map(df.select(ident.cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), work, MATRIX)


def entries(batch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a block."""
    return tuple(np.frombuffer(batch.column(c)[i].as_py(), "<u4").astype(np.int64) for c in (5, 6))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows. Each task sums its blocks; the driver gets a row for each bucket."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                b, n = entries(batch, i)
                total += np.bincount(b, weights=n, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield there, total[there]

    sums = np.zeros(buckets, np.int64)
    for r in arrow_map(blocks, work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r.bucket] = r.n
    return sums


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much likelier each bucket is in the target, each count raised by one."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """id, block, place, n_words, n_features, weight of each row: the floored mean of its features' gains, 0 without any."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, n = entries(batch, i)
                upto = np.concatenate([[0], np.cumsum(gains[b] * n)])
                starts, features = (batch.column(c)[i].values.to_numpy() for c in (4, 3))
                total = upto[starts[1:]] - upto[starts[:-1]]
                size = len(features)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield batch.column(1)[i].values, np.full(size, batch.column(0)[i].as_py()), np.arange(size), batch.column(2)[i].values, features, weight

    return arrow_map(blocks, work, "id long, block long, place long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Noise of a row in whole thousandths, by the first 32 bits of a hash of seed and id; a null id hashes as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: Callable[[int], int], eligible: Column) -> DataFrame:
    """scored (a written table with id, block, place, score) with rank: 1, 2, ... of the share(number of eligible rows) highest
    scores of eligible rows, ties by id (null first), then block and place; null of all other rows.

    Scores are whole numbers of a narrow range, so their histogram tells the least score that is drawn. Only rows of that
    score or more are sorted, by ranges; a range's first rank is the number of rows in the ranges before it.
    """
    counts = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, taken, least = share(sum(n for _, n in counts)), 0, None
    for score, n in counts:
        if taken >= wanted:
            break
        taken, least = taken + n, score
    inside = F.coalesce(eligible & (F.col("score") >= least), F.lit(False)) if taken else F.lit(False)
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    if not taken:
        return rest
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("block"), F.asc("place")]
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = scored.where(inside).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number of a partition, and of a row in it
    at = F.monotonically_increasing_id()
    lined = materialise(lined.withColumns({"part": F.shiftrightunsigned(at, 33), "nth": at.bitwiseAND(F.lit((1 << 33) - 1))}), "lined")
    before, bases = 0, []
    for r in lined.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        bases.append((r.part, before))
        before += r.n
    table = scored.sparkSession.createDataFrame(bases, "part long, base long")
    rank = F.col("nth") + F.col("base") + 1
    drawn = lined.join(F.broadcast(table), "part").withColumn("rank", F.when(rank <= wanted, rank)).drop("part", "nth", "base")
    return drawn.select(*rest.columns).unionByName(rest)


def resample(df: DataFrame, target: DataFrame, share: Callable[[int], int], buckets: int = BUCKETS, run: int = RUN, min_words: int = 20, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every row of df; share(n) of the n rows with min_words words are drawn.

    Null and empty texts have no features and weight 0, and stay undrawn unless min_words is 0. Rows that repeat are drawn
    each by themselves, with equal scores. An empty target gives gains by the corpus alone; an empty table no rows.
    Columns other than those named aren't read, so their names can't clash.
    """
    blocks = materialise(matrix(df, buckets, run, id_col, text_col), "matrix")
    wanted = column_sums(matrix(target, buckets, run, None, target_col), buckets)
    found = weights(blocks, gains_of(column_sums(blocks, buckets), wanted))
    scored = materialise(found.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    out = ranked(scored, share, F.col("n_words") >= min_words)
    return out.select("id", "n_words", "n_features", "weight", "score", "rank")
