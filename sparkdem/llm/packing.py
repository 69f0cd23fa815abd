"""Packing of token sequences by non-negative least squares over a histogram of lengths.

1. Every document is encoded once and cut into pieces of a whole window and one shorter rest. Each task numbers its pieces
   within their length, so that no length, however common, is one task's work.
2. The driver gets the histogram of lengths, a row for each length up to the window. Combinations of few lengths that fill
   a window are enumerated, and their repeat counts are solved by non-negative least squares. Rounded counts are cut to
   what there is; lengths that are left over are packed greedily into further combinations.
3. The combinations' places are dealt to the pieces by their numbers, in a map over the written pieces.

The plan's size depends on the window alone, so the third step carries it in its function.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdem.llm.bpe import batches_of_texts, encode_texts, vocabulary
from sparkdem.llm.common import arrow_map, held, materialise

#: Rounds of descent at most, and the share of the histogram by which the objective's slope may be off at the end.
ROUNDS, TOLERANCE = 300, 1e-3
#: Bits of a piece's number within its length, in a key made of both.
NUMBER_BITS = 48


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) out of the sorted ones, ascending, that fill the window: one, two or three of them."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [np.array([[0, 0, window]])] if there[window] else []
    low = lengths[lengths <= window // 2]
    pairs = low[there[window - low]]
    found.append(np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1))
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found).astype(np.int64)


def disjoint(rows: np.ndarray) -> np.ndarray:
    """Places of rows, taken in order, that share no length with one taken before."""
    used, taken = {0: False}, []
    for i, (a, b, c) in enumerate(rows.tolist()):
        if not (a and a in used or b and b in used or c in used):
            used[a] = used[b] = used[c] = True
            taken.append(i)
    return np.array(taken, np.int64)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Counts x >= 0 of the combinations that make the weighted squares of (lengths used - histogram) least.

    Descent in blocks: in each round those combinations that gain most, and share no length, each take the step that is
    best along them; as they share none, these steps are exact together. It ends where no feasible step is worth more
    than the tolerance of the largest count.
    """
    n = len(combos)
    x, left = np.zeros(n), histogram.astype(float).copy()
    if not n:
        return x
    w = weights**2
    w[0] = 0.0
    a, b, c = combos.T
    # squares of the columns: lengths that a combination has twice or three times count so
    square = w[a] * (1 + 2 * (a == b)) + w[b] * (1 + 2 * (b == c)) + w[c] + 2 * w[c] * ((a == c) & (a > 0))
    enough = tolerance * max(1.0, float(histogram.max()))
    for _ in range(rounds):
        pull = w * left
        step = np.maximum((pull[a] + pull[b] + pull[c]) / square, -x)
        gain = step * step * square
        most = np.argpartition(-gain, min(n - 1, 2048))[:2048]
        most = most[np.argsort(-gain[most], kind="stable")]
        most = most[np.abs(step[most]) > enough]
        if not len(most):
            break
        most = most[disjoint(combos[most])]
        x[most] += step[most]
        for part in (a, b, c):
            np.subtract.at(left, part[most], step[most])
    return x


def within(combos: np.ndarray, counts: np.ndarray, left: np.ndarray) -> list[tuple[list[int], int]]:
    """The rounded counts, the largest first, as far as the lengths last: (lengths, repeats). Takes them from left."""
    plan = []
    whole = np.rint(counts).astype(np.int64)
    for i in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)].tolist():
        lengths = [v for v in combos[i].tolist() if v]
        repeats = min(int(whole[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if repeats > 0:
            for v in lengths:
                left[v] -= repeats
            plan.append((lengths, repeats))
    return plan


def fill_greedily(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Packs all that is left: the longest length, then, while something fits, the one or two lengths that leave the smallest
    gap. A combination is repeated until one of its lengths is used up, so there are at most as many as lengths."""
    plan = []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        mine, gap, own = [longest], window - longest, left.copy()
        own[longest] -= 1
        while gap and (fits := np.flatnonzero(own[: gap + 1])).size:
            # the largest length in stock up to each gap, beside each first length
            upto = np.maximum.accumulate(np.where(own[: gap + 1] > 0, np.arange(gap + 1), 0))
            second = upto[gap - fits]
            second = np.where((second == fits) & (own[fits] < 2), upto[np.maximum(fits - 1, 0)], second)
            second = np.where(second + fits > gap, 0, second)
            best = int(np.argmax(fits + second))
            first, other = int(fits[best]), int(second[best])
            # a short length that has to be repeated often is taken many times at once
            times = max(1, min(int(own[first]), gap // (4 * first))) if first == other or not other else 1
            taken = [first] * times + ([other] if other and first * times + other <= gap and own[other] > (times if other == first else 0) else [])
            for v in taken:
                own[v] -= 1
            mine += taken
            gap -= sum(taken)
        sizes, many = np.unique(mine, return_counts=True)
        repeats = int((left[sizes] // many).min())
        left[sizes] -= repeats * many
        plan.append((sorted(mine), repeats))
    return plan


def plan_windows(histogram: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use up a histogram of lengths (index: length, up to the window)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    # long lengths that are left over cost a window each, short ones fill gaps
    weights = np.arange(window + 1) / window + 0.1
    plan = within(combos, solve_counts(combos, left, weights), left)
    return plan + fill_greedily(left, window)


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """What a piece's length and number tell: for each length in each combination the key of the first number, how often the
    combination has it, the combination's first sequence, and the offset of the first of them there; sorted by key."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, repeats in plan:
        offset = 0
        for v in sorted(set(lengths)):
            k = lengths.count(v)
            first = taken.get(v, 0)
            rows.append(((v << NUMBER_BITS) | first, k, sequence, offset))
            taken[v] = first + k * repeats
            offset += k * v
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "k", "sequence", "offset"), table.T))


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of so many bytes each, cut from the array's bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def bytes_under(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, sizes) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets.astype(np.int64))


def cut_documents(df: DataFrame, vocab_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, unit, number, start, length, doc_tokens, ids (binary) of each piece of each encoded document: whole windows, and the
    rest. number counts the pieces of that length in their unit, a task's output."""
    width = np.dtype("<u2") if max(len(vocabulary(vocab_path).bytes_of) - 1, end_id) < 1 << 16 else np.dtype("<u4")

    def run(batches):
        vocab, seen = vocabulary(vocab_path), np.zeros(window + 1, np.int64)
        unit = int.from_bytes(os.urandom(8), "little", signed=True)
        for batch in batches:
            for first, texts in batches_of_texts(batch):
                ids, sizes = encode_texts(texts, vocab)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(width)
                tokens = sizes + 1
                n = -(-tokens // window)
                doc = np.repeat(np.arange(len(texts)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(tokens[doc] - start, window)
                # numbers go on from those of the batches before
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=window + 1)
                names = batch.column(0).slice(first, len(texts)).take(pa.array(doc))
                yield names, np.full(len(doc), unit), number, start, length.astype(np.int32), tokens[doc], binaries(ids, length * width.itemsize)

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(docs, run, "id long, unit long, number long, start long, length int, doc_tokens long, ids binary")


def pack(df: DataFrame, vocab_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: every id of every
    document, end_id appended, in one piece of one sequence of at most `window` ids. Offsets of a sequence have no gap.

    Null and empty texts have the end id only. Rows that repeat, or share an id, are documents each; a null id stays null.
    An empty table gives no rows. Columns other than the two named aren't read, so their names can't clash. Which of two
    pieces of one length gets which place isn't fixed; the sequences' lengths are.
    """
    if not 1 <= window < 1 << 15:
        raise ValueError("a window has 1 to 32767 ids")
    pieces = materialise(cut_documents(df, vocab_path, window, end_id, id_col, text_col), "pieces")
    units = materialise(pieces.groupBy("unit", "length").agg(F.count("*").alias("n")), "units")
    histogram = np.zeros(window + 1, np.int64)
    for r in units.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to the window
        histogram[r.length] = r.n
    at = places(plan_windows(histogram, window))
    before = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(units.select("unit", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")

    def run(batches):
        for batch in batches:
            start, length, tokens, number, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4, 5))
            own = (length.astype(np.int64) << NUMBER_BITS) | (number + base)
            row = np.searchsorted(at["key"], own, side="right") - 1
            nth = own - at["key"][row]
            data, sizes = bytes_under(batch.column(6))
            if len(data):
                data = data.view("<u2" if int(sizes[0]) == 2 * int(length[0]) else "<u4").astype("<u4")
            sequence = at["sequence"][row] + nth // at["k"][row]
            offset = at["offset"][row] + nth % at["k"][row] * length
            yield batch.column(0), start, batch.column(2), binaries(data, length.astype(np.int64) * 4), tokens, sequence, offset

    placed = held(pieces, bases, ["unit", "length"]).select("id", "start", "length", "doc_tokens", "number", "base", "ids")
    return arrow_map(placed, run, "doc_id long, start long, length int, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, filled, ids (binary of window little-endian unsigned 32-bit ids), pieces (array of doc_id, start, length,
    offset): the sequences, padded. A sequence is one value of at most 4 * window bytes."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))")
    padding = F.lit(int(pad_id).to_bytes(4, "little"))
    return rows.select(
        "sequence_id",
        F.expr("aggregate(p, 0, (a, x) -> a + x.length)").alias("filled"),
        F.rpad(joined, 4 * window, padding).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"),
    )
