"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

The largest inner products are the nearest neighbours of augmented vectors: a candidate x gets one more component,
sqrt(M^2 - |x|^2), where M is the largest norm, and an anchor a zero, so |a, x|^2 = |a|^2 + M^2 - 2 a.x. Pivots cut this space
into Voronoi cells. Cells of anchors are put together to groups of bounded size; a cell of more anchors is cut by a hash.

For each cell of anchors it is known how far its anchors lie from its pivot, and how far a candidate may, or must, be to
serve one of them. So a candidate's distances to the pivots bound its distance to all anchors of each cell (triangle
inequality), and it is sent only to the groups that it might serve, once to each. There it is compared exactly, in
blocks of bounded size. Two such joins: nearest rows of an anchor's own label, then rows of other labels whose scores lie
in a band under each of these.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sparkdem.llm.common import BROADCAST_ROWS, arrow_map, hashed_sample, held, materialise

#: Pivots; anchors in a group, and candidates in a block, about: bounds of memory and of a task, without effect on results.
PIVOTS, GROUP_ANCHORS, BLOCK_ROWS = 64, 2048, 8192
#: Relative slack of the bounds, far above the rounding of distances in doubles.
SLACK = 1e-6
#: Whole numbers below this are exact in doubles.
EXACT = 1 << 53


def whole_vectors(df: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, label, v (whole numbers as doubles) of the rows that take part: id and label aren't null, and the vector has
    components, all finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(fine).select("id", "label", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while they hold all partial sums, Python's whole numbers beyond."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < EXACT:
        return a @ x.T
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(a) @ whole(x).T


class Space:
    """Pivots in the augmented space."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots = self.lifted(pivots)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))])

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each row of x (anchors: with a zero as last component) to each pivot."""
        y = np.column_stack([x, np.zeros(len(x))]) if anchors else self.lifted(x)
        squares = (y * y).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))

    def slack(self) -> float:
        """More than the rounding of any distance here: the square root of rounded squares loses half of the digits."""
        return SLACK * float(np.sqrt(self.most + (self.pivots**2).sum(axis=1).max(initial=0.0))) + 1e-12


def grouped_cells(pivots: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell, number of parts it is cut into): cells are halved along principal directions until a group has
    GROUP_ANCHORS anchors at most; a single cell of more is cut, and its parts are groups of their own, one after another."""
    group, parts, number = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0
    todo = [np.flatnonzero(sizes)]
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and sizes[cells].sum() > GROUP_ANCHORS:
            centred = pivots[cells] - pivots[cells].mean(axis=0)
            order = cells[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
            half = np.cumsum(sizes[order])
            cut = int(np.clip(np.searchsorted(half, half[-1] / 2) + 1, 1, len(order) - 1))
            todo += [order[:cut], order[cut:]]
        elif len(cells):
            parts[cells] = max(1, -(-int(sizes[cells].sum()) // GROUP_ANCHORS)) if len(cells) == 1 else 1
            group[cells] = number
            number += int(parts[cells[0]])
    return group, parts


def with_distances(rows: DataFrame, space: Space, dim: int, anchors: bool) -> DataFrame:
    """rows (id, label, v) with cell (the nearest pivot) and far (its distance)."""

    def run(batches):
        for batch in batches:
            d = space.distances(matrix(batch.column(2), dim), anchors)
            cell = d.argmin(axis=1)
            yield batch.column(0), batch.column(1), batch.column(2), cell.astype(np.int32), d[np.arange(len(d)), cell]

    return arrow_map(rows.select("id", "label", "v"), run, "id long, label long, v array<double>, cell int, far double")


def routed(rows: DataFrame, space: Space, dim: int, nearest: np.ndarray, farthest: np.ndarray | None, group: np.ndarray, parts: np.ndarray, radius: np.ndarray) -> DataFrame:
    """id, label, v, group of the candidates (id, label, v), once for each group that one might serve. farthest is by cell; if
    it is None, the candidates have a column of that name, an array by cell.

    An anchor in cell i is within radius[i] of its pivot, so a candidate at d from that pivot lies between d - radius[i] and
    d + radius[i] from it. It may serve an anchor of the cell only if that range meets nearest[i] to farthest[i] (negative
    where the cell has no anchor for it).
    """
    slack, kept = space.slack(), ["id", "label", "v", *(["farthest"] if farthest is None else [])]

    def run(batches):
        for batch in batches:
            d = space.distances(matrix(batch.column(2), dim), False)
            far = matrix(batch.column(3), len(radius)) if farthest is None else farthest
            serves = (far >= 0) & (d - radius <= far + slack) & (d + radius >= nearest - slack)
            out = [sorted({g for i in np.flatnonzero(row) for g in range(group[i], group[i] + parts[i])}) for row in serves]
            yield batch.column(0), batch.column(1), batch.column(2), out

    return arrow_map(rows.select(*kept), run, "id long, label long, v array<double>, groups array<long>").select("id", "label", "v", F.explode("groups").alias("group"))


def joined(anchors: DataFrame, candidates: DataFrame, match, schema: str) -> DataFrame:
    """match(anchors, candidates) of each group and block of its candidates, as tables: a block is dealt by a hash of ids, so a
    group of any size, or of copies of one vector, has bounded tasks."""
    sizes = materialise(candidates.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "blocks")
    a = held(anchors, sizes, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    c = held(candidates, sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = match(left, right) if len(left) and len(right) else []
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return a.groupBy("group", "block").cogroup(c.groupBy("group", "block")).applyInArrow(run, schema)


def first_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows of each key, higher scores first, then smaller ids, with rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor, label: Column | None = None, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id, negative_score of each row for which is_anchor(id column) holds.

    Components become floor(scale * x); scores are inner products. Positives are the first rows of the anchor's label but
    rows of its own id; negatives of a positive the first rows of other labels with band[0] * positive score <=
    100 * score <= band[1] * positive score. Higher scores come first, ties by smaller id. Rows without id or label, and
    vectors that are null, empty or hold a null or non-finite component take no part, nor do vectors of another
    dimension than the most common one of the sample of pivots. Rows that repeat are candidates each; anchors of one id
    and equal vectors and labels are one. Without anchors, positives or negatives there are no rows. Columns other
    than those named aren't read, so their names can't clash.
    """
    spark, label = df.sparkSession, F.col(label_col) if label is None else label
    empty = "anchor_id long, positive_id long, positive_score long, rank int, negative_id long, negative_score long"
    rows = materialise(whole_vectors(df, label, id_col, vec_col, scale), "vectors")
    sample = hashed_sample(rows.select("id", "v"), ["id", "v"], 4 * PIVOTS).collect()
    if not sample:
        return spark.createDataFrame([], empty)
    dims, counts = np.unique([len(r.v) for r in sample], return_counts=True)
    dim = int(dims[counts.argmax()])
    rows = rows.where(F.size("v") == dim)
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()[0]
    distinct = dict.fromkeys(tuple(r.v) for r in sample if len(r.v) == dim)
    space = Space(np.array(list(distinct)[:PIVOTS]), most)
    n_cells = len(space.pivots)

    asked = with_distances(rows.where(is_anchor(F.col("id"))).dropDuplicates(["id", "label", "v"]), space, dim, True)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    asked = materialise(asked.withColumns({"square": square, "vector": F.xxhash64("v")}), "anchors")
    radius, sizes = np.zeros(n_cells), np.zeros(n_cells, np.int64)
    for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r.cell], sizes[r.cell] = r.far, r.n
    if not sizes.any():
        return spark.createDataFrame([], empty)
    group, parts = grouped_cells(space.pivots, sizes)
    cells = spark.createDataFrame([(i, int(group[i]), int(parts[i])) for i in range(n_cells)], "cell int, first long, parts long")
    own = F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    asked = asked.join(F.broadcast(cells), "cell").select("id", "label", "v", "vector", "square", "cell", own.alias("group"))  # a row for each pivot

    farthest = bounds_of_positives(rows, asked, space, dim, radius, positives)
    near = routed(held(rows, farthest, "label", most=BROADCAST_ROWS // n_cells), space, dim, np.zeros(n_cells), None, group, parts, radius)
    found = joined(asked, materialise(near, "candidates"), lambda a, c: best_alike(a, c, dim, positives), "anchor long, vector long, label long, id long, score decimal(38,0)")
    found = materialise(first_of(found, positives, "anchor", "vector", "label"), "positives")

    scores = found.groupBy(F.col("anchor").alias("id"), F.col("vector"), F.col("label")).agg(F.array_sort(F.collect_set("score")).alias("wanted"))
    paired = materialise(asked.join(scores, ["id", "vector", "label"]), "paired")
    # of whole anchors: distances of the scores between which a negative may lie
    low, high = F.element_at("wanted", 1).cast("double") * (band[0] / 100), F.element_at("wanted", -1).cast("double") * (band[1] / 100)
    apart = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(float(space.most)) - 2 * s))
    ends = paired.where(F.element_at("wanted", -1) >= 0).groupBy("cell").agg(F.min(apart(high)).alias("near"), F.max(apart(F.greatest(F.lit(0.0), low))).alias("far")).collect()
    nearest, far = np.zeros(n_cells), np.full(n_cells, -1.0)
    for r in ends:  # a row for each pivot
        nearest[r.cell], far[r.cell] = r.near, r.far
    near = routed(rows, space, dim, nearest, far, group, parts, radius)
    other = joined(paired, materialise(near, "candidates"), lambda a, c: best_in_bands(a, c, dim, negatives, band), "anchor long, vector long, label long, wanted decimal(38,0), id long, score decimal(38,0)")
    other = first_of(other, negatives, "anchor", "vector", "label", "wanted").select("anchor", "vector", "label", F.col("wanted"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = found.select("anchor", "vector", "label", F.col("id").alias("positive_id"), F.col("score").alias("wanted"))
    out = positive.join(other, ["anchor", "vector", "label", "wanted"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("wanted").cast("long").alias("positive_score"), "rank", "negative_id", F.col("negative_score").cast("long").alias("negative_score"))


def bounds_of_positives(rows: DataFrame, asked: DataFrame, space: Space, dim: int, radius: np.ndarray, k: int) -> DataFrame:
    """label, farthest (array by cell): how far a row of that label may be to be among the k first of an anchor of the cell and
    label; negative where there is none. Of each cell and label, the k + 1 rows nearest to the pivot (one may have the
    anchor's own id, and more where ids repeat) bound it from above."""
    placed = with_distances(rows, space, dim, False).select("cell", "label", "id", "far")
    # different ids only: rows of the anchor's own id don't count
    close = placed.groupBy("cell", "label", "id").agg(F.min("far").alias("far"))
    order = Window.partitionBy("cell", "label").orderBy("far")
    close = close.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("cell", "label", "far")
    gaps = np.sqrt(np.maximum(((space.pivots[:, None] - space.pivots[None]) ** 2).sum(axis=2), 0))
    here = np.unique([r.cell for r in asked.select("cell").distinct().collect()])  # a row for each pivot
    pairs = [(int(j), int(i), float(gaps[i, j] + radius[i])) for i in here for j in range(len(radius))]
    reach = rows.sparkSession.createDataFrame(pairs, "cell int, anchors int, base double")  # PIVOTS * PIVOTS rows at most
    upto = close.join(F.broadcast(reach), "cell").select("label", "anchors", (F.col("far") + F.col("base")).alias("bound"))
    upto = upto.withColumn("r", F.row_number().over(Window.partitionBy("label", "anchors").orderBy("bound"))).where(F.col("r") <= k + 1)
    upto = upto.groupBy("label", "anchors").agg(F.max("bound").alias("bound"), F.count("*").alias("n"))
    # only cells that have anchors of the label; too few rows give no bound
    pairs = asked.select("label", F.col("cell").alias("anchors")).distinct()
    upto = pairs.join(upto, ["label", "anchors"]).select("label", "anchors", F.when(F.col("n") > k, F.col("bound")).otherwise(float("inf")).alias("bound"))
    by_cell = F.map_from_entries(F.collect_list(F.struct("anchors", "bound")))
    found = upto.groupBy("label").agg(by_cell.alias("m"))
    return materialise(found.select("label", F.expr(f"transform(sequence(0, {len(radius) - 1}), i -> coalesce(try_element_at(m, i), -1D))").alias("farthest")), "farthest")


def names(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["id"].to_numpy(), table["label"].to_numpy()


def best_alike(a: pa.Table, c: pa.Table, dim: int, k: int) -> list[tuple]:
    """(anchor, hash of its vector, label, id, score) of each anchor's k first candidates of its own label."""
    (ids, labels), (other, classes), out = names(a), names(c), []
    vectors, x = matrix(a["v"], dim), matrix(c["v"], dim)
    marks = a["vector"].to_pylist()
    for label in np.unique(labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(classes == label)
        for i in range(0, len(mine), 256):
            part = mine[i : i + 256]
            s = products(vectors[part], x[theirs])
            for r, row in zip(part.tolist(), s):
                spot = np.flatnonzero(other[theirs] != ids[r])
                if len(spot) > 4 * k:
                    bar = np.partition(row[spot], len(spot) - k)[len(spot) - k]
                    spot = spot[row[spot] >= bar]
                order = spot[np.lexsort((other[theirs[spot]], -row[spot]))[:k]]
                out += [(int(ids[r]), marks[r], int(label), int(other[theirs[t]]), whole(row[t])) for t in order]
    return out


def whole(score):
    return Decimal(int(score))


def best_in_bands(a: pa.Table, c: pa.Table, dim: int, k: int, band: tuple[int, int]) -> list[tuple]:
    """(anchor, hash of its vector, label, wanted score, id, score) of the k first candidates of other labels in the band of
    each of each anchor's wanted scores."""
    (ids, labels), (other, classes), out = names(a), names(c), []
    vectors, x, marks, wanted = matrix(a["v"], dim), matrix(c["v"], dim), a["vector"].to_pylist(), a["wanted"].to_pylist()
    for i in range(0, len(a), 256):
        s = products(vectors[i : i + 256], x)
        for r, row in enumerate(s, i):
            bands = [(-(-band[0] * int(p) // 100), band[1] * int(p) // 100, p) for p in wanted[r]]
            low, high = min(b[0] for b in bands), max(b[1] for b in bands)
            spot = np.flatnonzero((row >= low) & (row <= high) & (classes != labels[r]))
            spot = spot[np.lexsort((other[spot], -row[spot]))]
            falling = -row[spot]
            for low, high, p in bands:
                first, end = np.searchsorted(falling, -high, side="left"), np.searchsorted(falling, -low, side="right")
                out += [(int(ids[r]), marks[r], int(labels[r]), p, int(other[t]), whole(row[t])) for t in spot[first : min(end, first + k)]]
    return out
