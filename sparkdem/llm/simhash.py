"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most three bits, then one of
the two segments differs in at most one. So each segment is indexed once as it is, and once for each of its 32 bits
with that bit struck out. Fingerprints whose bit is 0 there meet those whose bit is 1 in an equality join; what meets
is verified on all 64 bits inside the join. Only distinct fingerprints are indexed: copies never meet each other.

Texts whose shingle sets have a Jaccard similarity of 0.8 lie about ten bits apart, where segments this long don't meet.
Where a similarity is asked for, bands of minima of the same shingles' hashes give the further candidates, which are
verified by the exact Jaccard similarity of the sets.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdem.llm.common import arrow_map, carried, components, materialise, scratch, uncarried

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


#: Bands of minima, and minima in each: at a similarity of 0.8 a pair shares a band with a chance of 0.9993.
BANDS, ROWS = 24, 6
_random = np.random.default_rng(17)
FACTORS, ADDENDS = (_random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of one text, repeats included; none if it has no word."""
    found = WORD.findall(text.translate(UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def simhash64(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of one text; zero if it has no word."""
    return simhash_of(shingle_hashes(text, words, seed))


def simhash_of(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashed shingles; zero if there are none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def named_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (a hash of the text, which tells rows of one id apart), text."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text, F.isnull(text)).alias("t"), text.alias("text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, t (hash of the text), fp (signed long) of every row. A null text counts as an empty one, whose fingerprint is zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            yield batch.column(0), batch.column(1), [simhash64((t.as_py() or "").encode("utf-8", "surrogatepass"), words) for t in texts]

    return arrow_map(named_texts(df, id_col, text_col), run, "id long, t long, fp long")


def variants(distinct: DataFrame, side: int) -> DataFrame:
    """key, fp: the two whole segments, and each segment with one bit struck out where that bit of fp equals side."""
    bit = "(shiftrightunsigned(fp, i) & 1L)"
    half = "(shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L)"
    struck = f"struct(shiftleft(cast(i as long), 32) | ({half} & ~shiftleft(1L, i % 32)) as key)"
    keys = f"""concat(
        transform(filter(sequence(0, 63), i -> {bit} = {side}), i -> {struck}),
        array(struct(shiftleft(64L, 32) | (fp & 4294967295L) as key), struct(shiftleft(65L, 32) | shiftrightunsigned(fp, 32) as key)))"""
    return distinct.select("fp", F.expr(f"inline({keys})"))


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: each pair of different fingerprints (column fp, distinct) at `distance` bits or fewer; distance at most 3. Each side
    is some 34 times its fingerprints, which Spark's estimate doesn't know, so it is told not to broadcast one."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments find pairs at three bits or fewer")
    a = variants(distinct, 0).select("key", F.col("fp").alias("u"))
    b = variants(distinct, 1).select("key", F.col("fp").alias("v")).hint("merge")
    near = a.join(b, (a.key == b.key) & (F.expr(f"bit_count(u ^ v) <= {distance}")) & ((a.key < (64 << 32)) | (F.col("u") < F.col("v"))))
    return near.select("u", "v").distinct()


def with_components(docs: DataFrame, mark: str, labels: DataFrame) -> DataFrame:
    """docs (id, t, mark) with component_id and kept, by the components of their marks (node, component). The first row of a
    component is the one of its smallest id (null last), and of that id's texts the one of the smallest hash. All sides grow with
    docs, so none is broadcast."""
    reps = docs.groupBy(mark).agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "t")).alias("rep"))
    rooted = reps.join(labels.hint("merge"), reps[mark] == labels.node, "left").select(mark, "rep", F.coalesce("component", mark).alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    named = rooted.join(first.hint("merge"), "root").select(mark, "first")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    return docs.join(named.hint("merge"), mark).select("id", "t", mark, F.col("first.id").alias("component_id"), kept.alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """id, t, fp, component_id, kept for every row: component_id is the smallest id reachable over links of fingerprints;
    kept is true for the component's first row, and for rows that repeat its id and text.

    Repeated rows and equal texts share a fingerprint and so a component. A null or empty text has the fingerprint
    zero and links like any other. A null id takes part, and gets the smallest id of its component (null if it has none).
    Columns other than the two named are not read, so their names can't clash.
    """
    docs = materialise(fingerprints(df, id_col, text_col, words), "simhash")
    return with_components(docs, "fp", components(links(docs.select("fp").distinct(), distance)))


def band_keys(distinct: np.ndarray) -> list[int]:
    """A signed key for each band of minima of different hashes; none without hashes."""
    if not len(distinct):
        return []
    with np.errstate(over="ignore"):
        m = np.min([(distinct[i : i + 4096, None] * FACTORS + ADDENDS).min(axis=0) for i in range(0, len(distinct), 4096)], axis=0)
    keys = [xxhash.xxh64_intdigest(m[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, t, fp, s (a hash of the set of shingles), keys of its bands and the set of shingles, as hashes, of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2):
                h = shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"), words)
                d = np.unique(h)
                s = np.array([xxhash.xxh64_intdigest(d.tobytes())], np.uint64).view(np.int64)
                rows.append((simhash_of(h), int(s[0]), band_keys(d), d.view(np.int64)))
            yield [batch.column(0), batch.column(1), *([r[k] for r in rows] for k in range(4))]

    schema = "id long, t long, fp long, s long, keys array<long>, shingles array<long>"
    return arrow_map(named_texts(df, id_col, text_col), run, schema)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets of shingles (s, shingles) have the least Jaccard similarity, in whole numbers."""
    p = round(100 * similarity)
    a, b = (sets.select(F.col("s").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v").where(f"least(size(su), size(sv)) * 100 >= greatest(size(su), size(sv)) * {p}")
    return both.where(f"{100 + p} * size(array_intersect(su, sv)) >= {p} * (size(su) + size(sv))").select("u", "v")


def with_picks(named: DataFrame) -> DataFrame:
    """u, v: each set (key, s, c) of a bucket and two drawn sets of it, where their components c differ."""
    drawn = F.struct(F.xxhash64("s", F.lit(0)), "s", "c")
    picks = named.groupBy("key").agg(F.explode(F.array(F.min(drawn), F.max(drawn))).alias("p"))
    return named.join(picks, "key").where("c <> p.c").select(F.least("s", "p.s").alias("u"), F.greatest("s", "p.s").alias("v")).distinct()


def all_apart(named: DataFrame) -> DataFrame:
    """u, v: all sets of different components that share a bucket; those outside of its largest one are held against all."""
    most = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"))
    few = named.join(most, "key").where("c <> most.c").select("key", F.col("s").alias("o"), F.col("c").alias("co"))
    return named.join(few, "key").where("c <> co").select(F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")).distinct()


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 3, similarity: float = 0.8) -> DataFrame:
    """id, t, s, component_id, kept for every row, as near_duplicates gives them; rows are also linked if their sets of
    shingles have the least similarity. Each bucket of a band is held against two of its sets first, and then, if it still has several
    components, all pairs of these are verified, so no pair of a bucket is left out."""
    docs = materialise(sketches(df, id_col, text_col, words), "sketches")
    prints = docs.select("fp", "s").distinct()
    first = materialise(prints.groupBy("fp").agg(F.min("s").alias("first")), "prints")
    equal = prints.join(first, "fp").where("s <> first").select(F.col("s").alias("u"), F.col("first").alias("v"))
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"s{x}")) for x in "uv")
    near = links(first.select("fp"), distance).join(a, "u").join(b, "v").select(F.col("su").alias("u"), F.col("sv").alias("v"))
    edges = materialise(equal.unionByName(near), "links")
    labels = components(edges)

    placed = docs.select(F.explode("keys").alias("key"), "s")
    shared = placed.groupBy("key").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x < y").select("key")
    rest = materialise(placed.join(materialise(shared, "keys"), "key", "left_semi").distinct(), "buckets")
    wanted = rest.select("s").distinct()
    sets = materialise(docs.select("s", "shingles").join(wanted, "s", "left_semi").dropDuplicates(["s"]), "sets")
    for pairs_of in (with_picks, all_apart):
        now = rest.join(labels, F.col("s") == F.col("node"), "left").select("key", "s", F.coalesce("component", "s").alias("c"))
        mixed = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
        rest = materialise(now.join(mixed, "key", "left_semi"), "mixed")
        edges = edges.unionByName(materialise(similar_pairs(materialise(pairs_of(rest), "pairs"), sets, similarity), "links"))
        labels = components(edges)
        rest = rest.drop("c")

    return with_components(docs.select("id", "t", "s"), "s", labels)


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """All columns of one row of each component: the one of its smallest id (null only where all are), and of rows of that
    id the one whose text has the smallest hash. With a similarity, texts whose sets of shingles are so alike are of one
    component, too. Of rows that repeat both id and text one stays, whichever. Columns of any name are kept as they are; null
    and empty texts are near-duplicates of each other, and an empty table gives no rows."""
    with scratch(df.sparkSession) as kept:
        if similarity is None:
            found = near_duplicates(df, id_col, text_col, words, distance)
        else:
            found = similar_texts(df, id_col, text_col, words, distance, similarity)
        keep = kept(materialise(found.where("kept").groupBy(F.col("id").alias("kept_id"), F.col("t").alias("kept_t")).agg(F.count("*").alias("n")), "kept"))
    rows = carried(df, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text", F.isnull("text")))
    stay = rows.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t")), "left_semi")
    return uncarried(stay.dropDuplicates(["id", "text"]) if keep.where("n > 1").head(1) else stay)
