"""Mixing sources to target weights: tempered shares, then budgeted block permutations.

A source with a share p of all tokens gets a weight in proportion to p ** a. The exponent a is bisected until the
weights meet a target entropy, or until no source is repeated more often than a limit. A source's rows are dealt to
blocks by a hash. Each block gets its part of the source's budget in tokens and spends it on permutations of its rows,
one after the other: whole passes, then the rows at the front of the next one that end within the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdem.llm.common import carried, materialise, uncarried

#: Rows in a block, on average: a block is permuted by one task, so a source of any share of all rows is many tasks' work.
ROWS_PER_BLOCK = 2_000
#: The plan is made on the driver, with a row for each source: beyond so many it is an error, not a large broadcast.
MOST_SOURCES = 100_000


def tempered(tokens: dict, a: float) -> dict:
    """Normalised weights in proportion to share ** a. Sources without tokens get none."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** a for s, n in tokens.items() if n > 0}
    whole = sum(raw.values())
    return {s: r / whole for s, r in raw.items()} | {s: 0.0 for s, n in tokens.items() if n <= 0}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repetitions(tokens: dict, weights: dict, budget: float | None) -> dict:
    """Passes over each source. Without a budget, the one at which the source with the fewest passes has just one."""
    rate = {s: weights[s] / n for s, n in tokens.items() if n > 0}
    budget = 1 / min(rate.values()) if budget is None else budget
    return {s: r * budget for s, r in rate.items()}


def bisect_exponent(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1]: the largest that still reaches the entropy, or the smallest that keeps within max_repeats.

    Both entropy and repetition fall as it grows. If even 0 misses the entropy it is 0; if even 1 is beyond the limit it
    is 1. With both given it is the larger of the two, so the limit holds; with neither it is 1.
    """
    if not any(n > 0 for n in tokens.values()):
        return 1.0

    def bisect(small) -> tuple[float, float]:
        """The last exponent that is too small by `small`, and the first that isn't."""
        low, high = 0.0, 1.0
        if not small(low):
            return low, low
        if small(high):
            return high, high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if small(mid) else (low, mid)
        return low, high

    found = []
    if target_entropy is not None:
        found.append(bisect(lambda a: entropy(tempered(tokens, a)) >= target_entropy)[0])
    if max_repeats is not None:
        found.append(bisect(lambda a: max(repetitions(tokens, tempered(tokens, a), budget).values()) > max_repeats)[1])
    return max(found, default=1.0)


def source_tokens(df: DataFrame, tokens_col: str, source_col: str = "source") -> dict:
    """Tokens of each source (null is one). The driver gets a row for each source, at most MOST_SOURCES; ValueError beyond."""
    sums = df.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.sum(F.greatest(F.lit(0), F.coalesce(tokens_col, F.lit(0)))).alias("n"))
    rows = sums.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: {source_col} doesn't name sources to be weighed")
    return {r.s: int(r.n) for r in rows}


def plan(df: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, tokens_col: str = "n", source_col: str = "source") -> list[tuple]:
    """(source, tokens, share, weight, passes) of each source. A source without any tokens costs nothing and gets one pass."""
    tokens = source_tokens(df, tokens_col, source_col)
    if not any(tokens.values()):
        return [(s, 0, 0.0, 0.0, 1.0) for s in tokens]
    weights = tempered(tokens, bisect_exponent(tokens, target_entropy, max_repeats, budget))
    passes = repetitions(tokens, weights, budget)
    total = sum(tokens.values())
    return [(s, n, n / total, weights[s], passes.get(s, 1.0)) for s, n in sorted(tokens.items(), key=lambda x: (x[0] is not None, x[0] or ""))]


def mix(df: DataFrame, key_col: str, tokens_col: str = "n", source_col: str = "source", seed: int = 0, **targets) -> DataFrame:
    """key, source, block, pass_no, position, tokens: a row for each time that a row of df is drawn.

    A source with p passes has each row in floor(p) permutations, and in the next one if its tokens end within what is
    left of its block's budget. Rows without tokens (null or none) cost nothing and are in every pass that the budget
    reaches: in each whole pass, and in the last one too if they come before it is spent. Rows that share a key are
    drawn together, under the least source among them. An empty table gives no rows. Two runs draw the same.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"), F.greatest(F.lit(0), F.coalesce(tokens_col, F.lit(0))).cast("long").alias("tokens"))
    rows = materialise(rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")), "mixing")
    passes = plan(rows, tokens_col="tokens", **targets)
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    table = spark.createDataFrame([(s, float(p), max(1, -(-counts[s] // ROWS_PER_BLOCK))) for s, _, _, _, p in passes] or [(None, 0.0, 1)], "s string, passes double, blocks long")
    dealt = rows.join(F.broadcast(table), rows.source.eqNullSafe(F.col("s"))).drop("s")  # a row for each source
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    totals = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("all"))
    # a rounding error must not cost a whole pass its last row
    whole = F.floor(F.col("passes") + 1e-9).cast("int")
    drawn = dealt.withColumn("pass_no", F.explode(F.sequence(F.lit(0), whole)))
    inside = Window.partitionBy("source", "block", "pass_no").orderBy(F.xxhash64("key", "pass_no", F.lit(seed + 1)), "key")
    drawn = drawn.withColumns({"position": F.row_number().over(inside).cast("long"), "spent": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("tokens").over(Window.partitionBy("source", "block", "pass_no"))})
    left = F.floor(F.col("all") * (F.col("passes") - whole) + 1e-6)
    keep = (F.col("pass_no") < whole) | ((left > 0) & (F.col("spent") <= left))
    return drawn.where(keep).select("key", "source", "block", "pass_no", "position", "tokens")


def mix_rows(df: DataFrame, drawn: DataFrame, key_col: str) -> DataFrame:
    """df's rows, each as often as its key was drawn; a null key is one. Columns of any name are kept as they are; rows whose
    key wasn't drawn go, and an empty table gives no rows."""
    times = drawn.groupBy(F.col("key").alias("drawn_key")).agg(F.count("*").cast("int").alias("times"))
    repeated = carried(df, F.col(key_col).cast("long").alias("own_key")).join(times, F.col("own_key").eqNullSafe(F.col("drawn_key")))
    return uncarried(repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))))
