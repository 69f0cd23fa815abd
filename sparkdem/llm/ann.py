"""Approximate nearest neighbours by learned partitions.

On a bounded sample: build the graph of nearest neighbours, cut it into balanced parts with few edges between them, and
train a small classifier to tell a vector's part. Every row is indexed in its most probable part. A query goes to its
several most probable parts, where all rows are compared with it exactly, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdem.llm.common import arrow_map, hashed_sample, materialise

#: The model is fitted on at most so many vectors (those with the least hash of id) and cuts them into parts of so many; so
#: many more, at most, are held out of the training, and tell how many parts a query must go to.
SAMPLE, PART, HELD_OUT = 4096, 96, 1024
#: Neighbours of a sampled vector in the graph; the hidden units of the classifier; the share of them its choice of parts must hold.
DEGREE, HIDDEN, AIM = 20, 128, 0.93
#: Rows and queries that meet in one group at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096


def nearest_in(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, n_parts: int, rounds: int = 15, slack: float = 1.15) -> np.ndarray:
    """The part of each row: halve along principal directions, then move rows to where most of their neighbours are,
    the largest gain first, as long as no part outgrows `slack` times the mean."""
    part = np.zeros(len(x), np.int64)
    todo, done = [(np.arange(len(x)), n_parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1:
            part[rows] = done
            done += 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    cap, size = slack * len(x) / n_parts, np.bincount(part, minlength=n_parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), neighbours.shape[1]), part[neighbours].ravel()), 1)
        np.add.at(votes, (neighbours.ravel(), np.repeat(part, neighbours.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        moved = 0
        for r in np.argsort(-gain, kind="stable")[: np.count_nonzero(gain)]:
            to = int(votes[r].argmax())
            if size[to] + 1 <= cap and to != part[r]:
                size[part[r]] -= 1
                size[to] += 1
                part[r] = to
                moved += 1
        if not moved:
            break
    return part


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Logits of the parts."""
    return np.maximum(x @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]


def train_classifier(x: np.ndarray, target: np.ndarray, steps: int = 400, seed: int = 1) -> dict:
    """A network of one hidden layer, trained by Adam to give each row's distribution over parts."""
    rng = np.random.default_rng(seed)
    shapes = {"w1": (x.shape[1], HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, target.shape[1]), "b2": (target.shape[1],)}
    m = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(len(x), 512))
        a, t = x[rows], target[rows]
        h = np.maximum(a @ m["w1"] + m["b1"], 0)
        z = h @ m["w2"] + m["b2"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - t) / len(rows)
        back = (d @ m["w2"].T) * (h > 0)
        grad = {"w1": a.T @ back, "b1": back.sum(axis=0), "w2": h.T @ d, "b2": d.sum(axis=0)}
        for k, g in grad.items():
            g = g + 1e-5 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return m


def fit(x: np.ndarray, k: int) -> dict:
    """The model: the classifier, its scale, the number of parts, and of probes. The last fifth of x (rows in no order) takes no
    part in the training; probes hold AIM of those neighbours of its rows that are in it, too, as most rows are new to the model."""
    out = min(HELD_OUT, len(x) // 5)
    held, every = x[len(x) - out :], x
    x = x[: len(x) - out]
    n_parts = max(1, len(x) // PART)
    scale = 1 / max(1e-300, float(np.sqrt((x**2).sum(axis=1).mean()))) if len(x) else 1.0
    if n_parts == 1:
        return {"n_parts": 1, "probes": 1, "scale": scale}
    x = x * scale
    degree = min(DEGREE, len(x) - 1)
    near = nearest_in(x, degree)
    part = balanced_parts(x, near, n_parts)
    # what a query must find: the parts of its neighbours, and for a row its own part
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), degree), part[near].ravel()), 0.5 / degree)
    target[np.arange(len(x)), part] += 0.5
    spread = max(1.0, np.sqrt(x.shape[1]))
    model = train_classifier(x * spread, target) | {"n_parts": n_parts, "scale": scale * spread}
    logits = probabilities(model, held * model["scale"])
    home = logits.argmax(axis=1)
    rank = np.argsort(np.argsort(-logits, axis=1), axis=1)
    scores = held @ every.T
    scores[np.arange(out), np.arange(len(x), len(every))] = -np.inf
    best = np.argpartition(-scores, min(k, len(every) - 1) - 1, axis=1)[:, : min(k, len(every) - 1)]
    query, spot = np.nonzero(best >= len(x))
    need = np.sort(rank[query, home[best[query, spot] - len(x)]])
    if not len(need):
        return model | {"probes": n_parts}
    model["probes"] = int(min(n_parts, need[int(AIM * (len(need) - 1))] + 1))
    return model


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles) of the rows that take part: id and vector aren't null, and it has components, all finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, id, score) of each query's k best of v. Scores are summed in one fixed order, so equal vectors tie."""
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(q), 128):
        rough = q[i : i + 128] @ v.T
        keep = min(k + 1, len(v))  # one more, since the query itself may be among them
        bar = np.partition(rough, len(v) - keep, axis=1)[:, len(v) - keep]
        for row, (name, b) in enumerate(zip(query_ids[i : i + 128], bar)):
            spot = np.flatnonzero(rough[row] >= b - 1e-9 * max(1.0, abs(b)))
            spot = spot[ids[spot] != name]
            score = (v[spot] * q[i + row]).sum(axis=1)
            order = np.lexsort((ids[spot], -score))[:k]
            out[0].extend([name] * len(order))
            out[1].extend(ids[spot[order]].tolist())
            out[2].extend(score[order].tolist())
    return out


def compare(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best of each query in each block of each part that it is sent to.

    rows: id, v, part; queries: id, v, part. Parts are cut into blocks by hashes of the ids, rows as well as queries;
    each pair of blocks meets in a task, so a part of any size, or a vector of many copies, has bounded groups.
    """
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a row for each part of the model
    asked = {r.part: r["count"] for r in queries.groupBy("part").count().collect()}
    both = sorted(sizes.keys() & asked.keys())
    if not both:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, score double")
    cuts = rows.sparkSession.createDataFrame([(p, -(-sizes[p] // BLOCK_ROWS), -(-asked[p] // BLOCK_QUERIES)) for p in both], "part int, nv long, nq long")
    dealt = lambda df, own, other: df.join(F.broadcast(cuts), "part").select("part", F.pmod(F.xxhash64("id"), F.col(own)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other"), "id", "v")
    a = dealt(rows, "nv", "nq").withColumnsRenamed({"own": "bv", "other": "bq"})
    b = dealt(queries, "nq", "nv").withColumnsRenamed({"own": "bq", "other": "bv"})

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = best_of(right["id"].to_numpy(), matrix(right["v"]), left["id"].to_numpy(), matrix(left["v"]), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["part", "bv", "bq"]
    return a.groupBy(keys).cogroup(b.groupBy(keys)).applyInArrow(run, "query_id long, id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k rows of largest inner product found for each row for which is_query(id column) holds.

    A row is no candidate for queries of its own id. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows without an id or of another dimension than the most common one of the sample.
    Ties go to the smaller id; rows that repeat are candidates each. If the probed parts hold fewer than k rows for a
    query, it is compared with all rows, so it gets k rows if there are so many. An empty table gives no rows.
    """
    valid = vectors_of(df, id_col, vec_col)
    sample = hashed_sample(valid, ["id"], SAMPLE + HELD_OUT).collect()
    if not sample:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    dims, counts = np.unique([len(r.v) for r in sample], return_counts=True)
    dim = int(dims[counts.argmax()])
    model = fit(np.array([r.v for r in sample if len(r.v) == dim]), k)
    valid = valid.where(F.size("v") == dim)

    def assign(probes: int):
        def run(batches):
            for batch in batches:
                x = matrix(batch.column(1))
                if model["n_parts"] == 1:
                    parts = np.zeros((len(x), 1), np.int32)
                else:
                    parts = np.argsort(-probabilities(model, x * model["scale"]), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32), pa.array(parts.ravel()))

        return run

    indexed = materialise(arrow_map(valid, assign(1), "id long, v array<double>, parts array<int>").select("id", "v", F.col("parts")[0].alias("part")), "index")
    asked = valid.where(is_query(F.col("id")))
    routed = arrow_map(asked, assign(model["probes"]), "id long, v array<double>, parts array<int>").select("id", "v", F.explode("parts").alias("part"))
    found = materialise(ranked(compare(indexed, routed, k), k), "found")
    few = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if model["probes"] == model["n_parts"] or not few.head(1):
        return found
    parts = F.explode(F.sequence(F.lit(0), F.lit(model["n_parts"] - 1)))
    rest = ranked(compare(indexed, few.select("id", "v", parts.alias("part")), k), k)
    return found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
