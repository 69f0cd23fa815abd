"""Sharding by sampled splitters, in DataFrame and SQL expressions only.

1. Draw a sample of the keys in which a row's chance is proportional to its size.
2. Take quantiles of the sampled keys as boundaries of many more ranges than there are shards.
3. Deal the rows to ranges, subdivide ranges that came out overfull by splitters drawn inside them, and sum sizes and counts
   per range. Of a range of one key and tie, whose rows have no order, rows are dealt at random and written.
4. A row's exact place in the key order is its range's offset plus a running sum inside its range; equal cuts of the
   total bytes make the shards, so two shards differ by about one row's size and no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdem.llm.common import carried, materialise

#: Keys drawn for each range; the sample is n_ranges times this, whatever the input.
DRAWS = 16
#: A range of so many times the mean size is overfull; turns in which such ranges are subdivided.
OVERFULL, TURNS = 4, 4
#: Large tables get a range for so many rows, up to so many ranges: what the driver holds of them stays bounded.
ROWS_PER_RANGE, MOST_RANGES = 250_000, 8192


def range_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of the last cut (key, tie) that isn't beyond a row's __k and __t, by halving; 0 before the second."""
    keys, ties = ([c[i] for c in cuts] for i in (0, 1))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    listed = lambda xs: f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)"
    return F.expr(f"""aggregate(array({", ".join(map(str, steps))}), 0, (at, step) ->
        if(at + step <= {len(cuts)} and (__k > element_at({listed(keys)}, at + step)
           or __k = element_at({listed(keys)}, at + step) and __t >= element_at({listed(ties)}, at + step)), at + step, at))""").cast("int")


def drawn_cuts(rows: DataFrame, target: int, seed: str) -> list[tuple[int, int]]:
    """Keys and ties (from __g, __k, __t, __s) about `target` bytes apart in each group __g, from a sample in which a row's chance is
    proportional to its size. The driver gets about as many as target goes into all sizes."""
    rate = max(1.0, target / DRAWS)
    chance = F.pmod(F.xxhash64("__k", "__t", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance < F.col("__s") / rate).select("__g", "__k", "__t", F.greatest(F.lit(rate), F.col("__s")).alias("w"))
    order = Window.partitionBy("__g").orderBy("__k", "__t").rowsBetween(Window.unboundedPreceding, 0)
    cuts = drawn.withColumn("q", F.floor(F.sum("w").over(order) / target)).groupBy("__g", "q").agg(F.min(F.struct("__k", "__t")).alias("at"))
    return sorted({(int(c[0]), int(c[1])) for c in cuts.select("at.*").collect()})


def next_place(cut: tuple[int, int]) -> tuple[int, int]:
    return (cut[0], cut[1] + 1) if cut[1] < 2**63 - 1 else (cut[0] + 1, -(2**63))


def assign_shards(df: DataFrame, n_shards: int, ranges_per_shard: int = 8) -> DataFrame:
    """df with columns key (long), tie (long) and size (long >= 0) gets shard (int) and slot (long, gapless from 0 in its shard).

    Rows are ordered by (key, tie). Law: the bytes of shards are equal but for the size of a row at the cuts. Equal keys
    lie together unless a cut goes through them; a key of any share of all rows is cut as needed, by its ties. Null keys
    and ties count as the smallest. Rows of equal key and tie take neighbouring slots in any order. An empty table gives
    no rows; if all sizes are zero, all rows go to shard 0. Other columns are kept; names that start with __ are used.
    """
    low = F.lit(-(2**63))
    rows = df.withColumns({"__k": F.coalesce("key", low), "__t": F.coalesce("tie", low), "__s": F.coalesce("size", F.lit(0)).cast("long")})
    total, count = (int(x or 0) for x in rows.agg(F.sum("__s"), F.count("*")).first())
    n_ranges = max(n_shards * ranges_per_shard, min(MOST_RANGES, count // ROWS_PER_RANGE))
    target = max(1, total // n_ranges)
    cuts = drawn_cuts(rows.withColumn("__g", F.lit(0)), target, "draw")
    for turn in range(TURNS):
        ranged = rows.withColumn("__g", range_of(cuts or [(-(2**63), -(2**63))]))
        place = F.struct("__k", "__t")
        sums = ranged.groupBy("__g").agg(F.sum("__s").alias("b"), (F.min(place) < F.max(place)).alias("mixed"))
        full = sums.where(F.col("b") > OVERFULL * target)
        if turn == TURNS - 1 or not full.where("mixed").head(1):
            break
        inside = ranged.join(F.broadcast(full.where("mixed").select("__g")), "__g", "left_semi")  # at most a row for each cut
        found = drawn_cuts(inside, target, f"draw {turn}")
        # a place of many rows becomes a range of its own
        cuts = sorted({*cuts, *found, *map(next_place, (c for c in found if c != (2**63 - 1, 2**63 - 1)))})
    parts = full.where("not mixed").select("__g", F.least(F.lit(4096), F.ceil(F.col("b") / target)).cast("int").alias("__n"))
    split = ranged.withColumnRenamed("__g", "__r").join(F.broadcast(parts.withColumnRenamed("__g", "__r")), "__r", "left")  # at most a row for each cut
    split = split.withColumn("__p", F.when(F.col("__n").isNull(), 0).otherwise(F.floor(F.rand() * F.col("__n"))).cast("int")).drop("__n")
    split = materialise(split, "ranges") if parts.head(1) else split
    sums = split.groupBy("__r", "__p").agg(F.sum("__s").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("__r", "__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__r", "__p", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"))
    inside = Window.partitionBy("__r", "__p").orderBy("__k", "__t")
    placed = (
        split.withColumns({"__b": F.sum("__s").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__i": F.row_number().over(inside)})
        .join(F.broadcast(offsets), ["__r", "__p"])  # at most n_ranges rows and a few for each subdivided one
        .withColumns({"__b": F.col("__b0") + F.col("__b") - F.expr("__s div 2") - 1, "__i": F.col("__n0") + F.col("__i") - 1})
        .withColumn("shard", F.greatest(F.lit(0), F.least(F.lit(n_shards - 1), F.floor(F.col("__b") * n_shards / max(1, total)))).cast("int"))
        .select(*df.columns, "shard", F.col("__i").alias("__i"))
    )
    placed = materialise(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("__i").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(*df.columns, "shard", (F.col("__i") - F.col("__first")).alias("slot"))


def shard_documents(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; key: the text's 64-bit hash, so that equal texts lie together.

    Size is the text's UTF-8 bytes plus 16 (null: none plus 16). The text itself is never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col(id_col).cast("long")).alias("tie"),
    )
    return assign_shards(materialise(narrow, "sizes"), n_shards).drop("key", "tie")


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes df's rows as Parquet folders by shard, in slot order; assigned holds one row for each id of df.

    The columns shard and slot are added; where df has a column of that name (in any case), an underscore is put to the
    end of the new one until none has. Rows of a null id are kept if assigned has one for it; an empty table has no folder.
    """
    taken, names = {c.lower() for c in df.columns}, []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        names.append(name)
    placed = assigned.select(F.col("doc_id").alias("placed_id"), F.col("shard").alias("to"), F.col("slot").alias("at"))
    joined = carried(df, F.col(id_col).cast("long").alias("own_id")).join(placed, F.col("own_id").eqNullSafe(F.col("placed_id")))
    laid = joined.repartition("to", F.expr("at div 100000")).sortWithinPartitions("to", "at")
    laid.select("row.*", F.col("to").alias(names[0]), F.col("at").alias(names[1])).write.partitionBy(names[0]).parquet(path)
