"""Fuzzy line dedup by MinHash, in DataFrame and SQL expressions only.

1. All lines are written once, with two 64-bit hashes. Lines that are equal but for white space at the ends are one class,
   named by the first hash; lines that share it but not the second are kept apart (`named_apart`).
2. The first line of each class is signed: every character shingle is hashed once, the hash deals it to one of BANDS bands
   and one of ROWS cells in it, and a band's key is made of the least hash of each cell. Short lines, whose shingles would
   leave cells empty, deal each shingle several times (DRAWS).
3. Classes that share a key are candidates. Each is held against one class of its bucket, so a bucket of many variants
   of one line costs a link each. What is found is joined to components.
4. In buckets that still hold several components, each class is held against a few drawn ones, which joins most near copies.
   Then all pairs of different components are held against each other; those outside the largest component only, and those
   of similar sizes, in chunks where a bucket is large. Bitmaps of the shingles give a lower bound of what two sets don't
   share, so pairs that can't reach the similarity end in the join.
5. Candidates are verified by the exact Jaccard similarity of their shingle sets, linked, and joined to components.
6. One letter changed costs SHINGLE shingles on each side, so lines of up to SHORT characters that are one edit apart
   don't reach the similarity. They are linked, too, and found exactly: such lines share a half, and of those that share
   a half with another line, all share a line with one letter left out. Each is linked to one line of a bucket.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdem.llm.common import components, held, materialise, scratch

#: Characters in a shingle, least similarity, and bands of cells: at 0.8 a pair shares a band with a chance of 0.986 or more.
SHINGLE, SIMILARITY, BANDS, ROWS = 8, 0.8, 14, 6
#: How often each shingle is dealt, with the least and the largest number of shingles of the lines that it is done for.
#: The ranges overlap by 1 / SIMILARITY, so two similar lines are signed alike in one of them.
DRAWS = {1: (112, None), 3: (36, 140), 14: (1, 45)}
#: A line that fills fewer of its BANDS * ROWS cells has few different shingles for its length: it is signed as a short one, too.
FILLED = 60
#: Which of these lack keys: f1 and f3 cells are filled by one draw and by three. At 112 to 140 places, lines of 45 different shingles
#: or fewer, that are to have 14 draws, fill less than FILLED_THRICE cells by three.
FILLED_THRICE = 76
UNSIGNED = f"places > {DRAWS[3][1]} or places > {DRAWS[14][1]} and f3 < if(f1 < {FILLED}, {FILLED_THRICE}, {FILLED})"
#: From 9 * SHINGLE shingles on, one edit leaves lines as similar as that; lines of SHINGLE to SHORT characters are also
#: linked if they are one edit apart.
SHORT = 80
#: Longs in a folded bitmap of shingles, and folds.
FOLDED, FOLDS = 16, 4
#: Classes of a bucket of several components that stand on one side of a join key, about: a bound of a task, without effect on
#: results.
HOT = 1000
#: Draws of two classes from a bucket of several components, before all of it is compared.
PICKS = 3
#: Lines that are signed, and pairs that are verified, in one partition, about: so few that their shingles' groups stay in a
#: processor's cache.
LINES_AT_A_TIME, PAIRS_AT_A_TIME = 4000, 150

SPACES = " \t\r\x0b\x0c"
#: trim takes all characters of a line apart, so it runs only where there is something to trim.
LINE = f"if({' or '.join(f"startswith(line, '{c}') or endswith(line, '{c}')" for c in SPACES)}, trim(BOTH '{SPACES}' FROM line), line)"


def first_hash() -> Column:
    return F.xxhash64("line")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row_key: equal rows (id and text) have equal keys."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text", F.isnull("text")))


def occurrences(docs: DataFrame) -> DataFrame:
    """h, g (two hashes), doc_id, row_key, line_no (from 0), places (of shingles; characters beyond the basic plane count
    twice), line of every line that isn't blank."""
    lines = docs.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "row_key", "line_no", F.expr(LINE).alias("line")).where("line <> ''")
    return lines.select(first_hash().alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc_id", "row_key", "line_no", F.expr(f"octet_length(encode(line, 'UTF-16BE')) div 2 - {SHINGLE - 1}").alias("places"), "line")


def classes_of(found: DataFrame) -> DataFrame:
    """h, first (doc_id, row_key, line_no of the first line), mixed (whether lines of that hash differ in the other one), places."""
    first = F.min(F.struct("doc_id", "row_key", "line_no")).alias("first")
    return found.groupBy("h").agg(first, (F.min("g") < F.max("g")).alias("mixed"), F.max("places").alias("places"))


def named_apart(found: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found and its classes, where lines that differ but share the first hash get another one, made of both."""
    mixed = classes.where("mixed").select(F.col("h").alias("__h"))
    if mixed.isEmpty():
        return found, classes
    both = found.join(mixed, found.h == F.col("__h"), "left")
    found = materialise(both.withColumn("h", F.when(F.col("__h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "g"))).drop("__h"), "lines", "zstd")
    return found, materialise(classes_of(found), "classes")


def represented(found: DataFrame, classes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """h, row_key, line_no, places, line: the first line of each class (of those in `only`, a written table of h; rows that repeat give
    it again). Both sides are dealt by all three keys, so a line of many copies isn't a hot one."""
    lines, keys = found.select("h", "row_key", "line_no", "places", "line"), ["h", "row_key", "line_no"]
    lines = lines if only is None else held(lines, only, "h", "left_semi")
    first = classes.select("h", F.col("first.row_key").alias("row_key"), F.col("first.line_no").alias("line_no"))
    parts = (classes if only is None else only).count() // LINES_AT_A_TIME
    return dealt(lines, parts, *keys).join(dealt(first, parts, *keys).hint("shuffle_hash"), keys, "left_semi")


def texts_of(found: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line of the classes in wanted (h)."""
    only = materialise(wanted.distinct(), "candidates")
    return materialise(represented(found, classes, only).select("h", "line").dropDuplicates(["h", "line"]), "texts")


def one_edit(lines: DataFrame) -> DataFrame:
    """u, v: links that join the classes (h, line) of SHINGLE to SHORT characters which are one edit apart (a letter other,
    more or less), all of them. Lines with the same letters but for the one at the same place are linked to the least of
    them; lines that become another one if a letter is left out are linked to that."""
    lines = materialise(lines.where(F.length("line").between(SHINGLE, SHORT)).select("h", "line", F.length("line").alias("n")).distinct(), "short")
    half = "flatten(transform(array_distinct(array(n div 2, (n - 1) div 2)), m -> array(xxhash64(0, m, left(line, int(m))), xxhash64(1, m, right(line, int(m))))))"
    halves = lines.select("h", F.explode(F.expr(half)).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("key")
    near = lines.join(halves.join(shared, "key", "left_semi").select("h").distinct(), "h", "left_semi")
    less = near.select("h", F.posexplode(F.expr("transform(sequence(1, n), i -> concat(left(line, i - 1), substring(line, i + 1)))")).alias("i", "less"))
    # where nothing stands in the place of the letter that is left out, only the line itself may be linked to
    keys = less.select("h", F.explode(F.array(F.struct(F.xxhash64("i", "less").alias("key"), F.col("h").alias("to")), F.struct(F.xxhash64(F.lit(-1), "less").alias("key"), F.lit(None).cast("long").alias("to")))).alias("k"))
    keys = keys.select("h", "k.key", "k.to").unionByName(near.select("h", F.xxhash64(F.lit(-1), "line").alias("key"), F.col("h").alias("to")))
    keys = materialise(keys, "edits")
    to = keys.groupBy("key").agg(F.min("to").alias("to"), F.min("h").alias("x"), F.max("h").alias("y")).where("to is not null and x < y").select("key", "to")
    found = keys.drop("to").join(to, "key").where("h <> to")
    return found.select(F.least("h", "to").alias("u"), F.greatest("h", "to").alias("v")).distinct()


def shingled(lines: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and x, the hash of a shingle, for each place in each line (column line of SHINGLE characters or more)."""
    units = lines.select(*kept, F.expr("encode(line, 'UTF-16BE')").alias("units"))
    placed = units.select(*kept, "units", F.explode(F.expr(f"sequence(1, octet_length(units) - {2 * SHINGLE - 1}, 2)")).alias("i"))
    return placed.select(*kept, F.expr(f"xxhash64(substring(units, i, {2 * SHINGLE}))").alias("x"))


def dealt(df: DataFrame, least: int, *keys: str) -> DataFrame:
    """df by keys, in so many partitions at least: few bytes of text are many shingles."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def signed(lines: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """h, draws, filled, key for each band of each line: its key, and how many of its cells are filled. Lines are dealt by h,
    row_key and line_no already, so that grouping them takes no shuffle."""
    each = shingled(lines, "h", "row_key", "line_no")
    if draws > 1 or seed:
        each = each.select("h", "row_key", "line_no", "x", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        each = each.select("h", "row_key", "line_no", F.xxhash64("x", "draw", F.lit(seed)).alias("x"))
    each = each.withColumns({"band": F.expr(f"int(shiftrightunsigned(x, 44) % {BANDS})"), "cell": F.expr(f"int((shiftrightunsigned(x, 24) & 1048575) % {ROWS})")})
    cells = [F.expr(f"min(x) filter (where cell = {r})").alias(f"m{r}") for r in range(ROWS)]
    bands = each.groupBy("h", "row_key", "line_no", "band").agg(*cells)
    filled = sum((F.col(f"m{r}").isNotNull().cast("int") for r in range(ROWS)), F.lit(0))
    key = F.xxhash64(F.lit(draws), F.lit(seed), "band", *(F.coalesce(f"m{r}", F.lit(0)) for r in range(ROWS)))
    return bands.select("h", F.lit(draws).alias("draws"), filled.alias("filled"), key.alias("key"))


def signatures(found: DataFrame, classes: DataFrame) -> DataFrame:
    """h, key of each class of lines of a shingle or more. The lines of each number of draws are written on their own, so what
    was dealt for one is off the disk before the next."""
    lines, parts = represented(found, classes), []
    for draws, (least, most) in DRAWS.items():
        parts.append(materialise(signed(lines.where(F.col("places").between(least, most or 1 << 31)), draws), "signatures"))
    first = functools.reduce(DataFrame.unionByName, parts)
    filled = (F.coalesce(F.sum(F.when(F.col("draws") == d, F.col("filled"))), F.lit(BANDS * ROWS)).alias(f"f{d}") for d in (1, 3))
    few = first.where(F.col("draws") < max(DRAWS)).groupBy("h").agg(*filled).where(f"f1 < {FILLED} or f3 < {FILLED}")
    # lines that are short enough have the further keys already
    few = materialise(few.join(classes.select("h", "places"), "h").where(UNSIGNED).select("h"), "few")
    if few.isEmpty():
        return first.select("h", "key")
    repetitive = represented(found, classes, few)
    more = materialise(signed(repetitive, 3).unionByName(signed(repetitive, 14)), "signatures")
    return first.unionByName(more).select("h", "key")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs u, v whose shingle sets have the least similarity, in whole numbers: the shingles of both lines are put
    together and counted. lines: h, line of all classes in pairs, each once."""
    p, parts = round(100 * SIMILARITY), pairs.count() // PAIRS_AT_A_TIME
    a, b = (lines.select(F.col("h").alias(x), F.col("line").alias(f"t{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    both = dealt(both, parts, "u", "v")
    sides = both.select("u", "v", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("tu").alias("line")), F.struct(F.lit(2).alias("side"), F.col("tv").alias("line")))).alias("s"))
    each = shingled(sides.select("u", "v", "s.side", "s.line"), "u", "v", "side").groupBy("u", "v", "x").agg(F.bit_or("side").alias("sides"))
    counts = each.groupBy("u", "v").agg(F.count("*").alias("either"), F.count_if(F.col("sides") == 3).alias("common"))
    return counts.where(F.col("common") * 100 >= F.col("either") * p).select("u", "v")


def bitmaps(texts: DataFrame) -> DataFrame:
    """h, n (different shingles, as far as their hashes tell), bits (a bit for the hash of each shingle), b0, b1, ... (the same,
    folded to fewer longs)."""
    each = shingled(dealt(texts, texts.count() // PAIRS_AT_A_TIME, "h"), "h").distinct()
    each = each.select("h", F.expr("int(shiftrightunsigned(x, 6) & 1048575)").alias("spot"), F.expr("shiftleft(1L, int(x & 63))").alias("bit"))
    each = each.withColumns({"fold": F.expr(f"spot div {FOLDED} % {FOLDS}"), "word": F.expr(f"spot % {FOLDED}")})
    words = [F.expr(f"bit_or(bit) filter (where word = {w})").alias(f"b{w}") for w in range(FOLDED)]
    parts = each.groupBy("h", "fold").agg(F.count("*").alias("n"), *words)
    parts = parts.select("h", "n", "fold", F.array(*(F.coalesce(f"b{w}", F.lit(0)) for w in range(FOLDED))).alias("bits"))
    none = f"array_repeat(0L, {FOLDED})"
    bits = F.concat(*(F.expr(f"coalesce(max(bits) filter (where fold = {k}), {none})") for k in range(FOLDS)))
    maps = parts.groupBy("h").agg(F.sum("n").alias("n"), bits.alias("bits"))
    folded = (F.expr(" | ".join(f"bits[{w + FOLDED * k}]" for k in range(FOLDS))).alias(f"b{w}") for w in range(FOLDED))
    return maps.select("h", "n", "bits", *folded)


def may_be_similar(other: str) -> str:
    """SQL for whether sets (n, bits, b0, ...) and those with a prefix can reach the similarity: a bit that only one of two
    bitmaps has is a shingle that only that set has, so at most n less these bits are common to both. The folded bitmaps
    are looked at first."""
    p = round(100 * SIMILARITY)
    enough = f"least(n - ({{}}), {other}n - ({{}})) * {100 + p} >= {p} * (n + {other}n)"
    own, others = (" + ".join(f"bit_count({a}b{w} & ~{b}b{w})" for w in range(FOLDED)) for a, b in (("", other), (other, "")))
    count = "aggregate(zip_with({}bits, {}bits, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    return f"{enough.format(own, others)} and {enough.format(count.format('', other), count.format(other, ''))}"


def prefixed(maps: DataFrame, prefix: str) -> DataFrame:
    return maps.select(*(F.col(c).alias(prefix + c) for c in maps.columns))


def plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs u, v that can reach the similarity."""
    both = pairs.join(maps, F.col("u") == F.col("h")).join(prefixed(maps, "o"), F.expr(f"v = oh and {may_be_similar('o')}"))
    return both.select("u", "v")


def all_apart(named: DataFrame, maps: DataFrame) -> DataFrame:
    """u, v: classes (key, h, c) of different components that share a bucket and may be similar. Those outside a bucket's
    largest component are held against all of it, which finds every such pair.

    Similar sets have similar sizes, so a class meets those of its own and the two neighbouring classes of size only; a
    bucket of more than HOT classes is dealt to chunks by a hash, and each class is sent to all of them. Nothing is left
    out by either, and a join key has HOT classes, about, on one side.
    """
    sizes = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.ceil(F.sum("n") / HOT).alias("chunks"))
    # a little wider than the similarity, so that rounding can't part two sets
    band = F.floor(F.log("n") / math.log(1 / SIMILARITY + 0.01)).cast("int")
    placed = named.join(sizes, "key").join(maps, "h").withColumn("size", band)
    few = placed.where("c <> most.c").drop("most").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("size", F.explode(F.expr("array(size - 1, size, size + 1)")))
    other = placed.drop("most").withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks")))
    other = other.select(F.col("key").alias("ko"), F.col("c").alias("co"), F.col("chunk").alias("oc"), F.col("size").alias("os"), *(F.col(c).alias(f"o{c}") for c in maps.columns))
    near = few.join(other, F.expr(f"key = ko and chunk = oc and size = os and c <> co and {may_be_similar('o')}"))
    return near.select(F.least("h", "oh").alias("u"), F.greatest("h", "oh").alias("v")).distinct()


def drawn_apart(named: DataFrame, maps: DataFrame) -> DataFrame:
    """u, v: the classes (key, h, c) of each bucket and up to 2 * PICKS drawn ones of it, where they are of different components
    and may be similar. Near copies of each other share several buckets, so they meet many and are joined; what isn't
    is left to all_apart."""
    drawn = [F.struct(F.xxhash64("h", "key", F.lit(k)), "h", "c") for k in range(PICKS)]
    picks = named.groupBy("key").agg(F.array_distinct(F.array(*(f(d) for d in drawn for f in (F.min, F.max)))).alias("picks"))
    met = named.join(picks, "key").select("h", "c", F.explode("picks").alias("p")).where("c <> p.c")
    pairs = met.select(F.least("h", "p.h").alias("u"), F.greatest("h", "p.h").alias("v")).distinct()
    return plausible(pairs, maps)


def mixed_buckets(named: DataFrame) -> DataFrame:
    """key, n of the buckets (key, h, c) with several components and more than two classes."""
    sizes = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n"))
    return sizes.where("x < y and n > 2").select("key", "n")


def still_mixed(named: DataFrame, labels: DataFrame) -> DataFrame:
    """key, h, c (the component) of the buckets (key, h) that hold several components."""
    named = named.join(labels, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("component", "h").alias("c"))
    named = materialise(named, "named")
    return materialise(named.join(mixed_buckets(named).select("key"), "key", "left_semi"), "mixed")


def similar_lines(found: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component: the classes that are joined to others. All else that is written on the way is deleted."""
    spark = found.sparkSession
    with scratch(spark) as kept:
        with scratch(spark) as needed:
            keys = signatures(found, classes)
            buckets = keys.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.count("*").alias("n")).where("x < y")
            buckets = materialise(buckets, "buckets")
            # the two ends of a bucket are a pair; the others of it are held against its least
            named = needed(materialise(held(keys, buckets.where("n > 2").select("key", "x"), "key").distinct(), "named"))
            stars = buckets.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(named.where("h <> x").select(F.col("x").alias("u"), F.col("h").alias("v")))
            pairs = needed(materialise(stars.distinct(), "pairs"))
        texts = texts_of(found, classes, pairs.select(F.explode(F.array("u", "v")).alias("h")))
        maps = materialise(bitmaps(texts), "bitmaps")
        links = verified(materialise(plausible(pairs, maps), "pairs"), texts)
        with scratch(spark) as needed:
            links = needed(materialise(links.unionByName(one_edit(represented(found, classes))), "links"))
        labels = components(links)
        named = still_mixed(named.drop("x"), labels)
        for pairs_of in (drawn_apart, all_apart):
            if named.isEmpty():
                break
            more = materialise(verified(materialise(pairs_of(named, maps), "pairs"), texts), "links")
            if more.isEmpty():
                continue
            links = links.unionByName(more)
            labels = components(links)
            if pairs_of is drawn_apart:
                named = still_mixed(named.drop("c"), labels)
        return kept(labels)


def line_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, line_no, component_id, kept for every line that isn't blank.

    Lines of one component are equal or joined by a chain of lines whose shingle sets are at least SIMILARITY alike, or
    that are one edit apart and have at most SHORT characters.
    kept is true for the first of a component in the order of doc_id (null first), row_key and line_no; component_id is
    the least hash of its lines. Blank lines and null texts have no rows. Lines shorter than a shingle join equal ones
    only. Rows that repeat id and text count as one. Other columns aren't read, so their names can't clash.
    """
    found = materialise(occurrences(keyed(df, id_col, text_col)), "lines", "zstd")
    found, classes = named_apart(found, materialise(classes_of(found), "classes"))
    labels = similar_lines(found, classes)
    rooted = classes.join(labels, classes.h == labels.node, "left").select("h", "first", F.coalesce("component", "h").alias("component_id"))
    roots = rooted.groupBy("component_id").agg(F.min("first").alias("first"))
    named = rooted.select("h", "component_id").join(roots, "component_id")
    lines = found.select("h", "doc_id", "row_key", "line_no").join(named, "h")
    kept = F.struct("doc_id", "row_key", "line_no").eqNullSafe(F.col("first"))
    return lines.select("doc_id", "row_key", "line_no", "component_id", kept.alias("kept")).dropDuplicates(["doc_id", "row_key", "line_no"])


def drop_duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with the lines that aren't kept taken out of text_col, and chars_col (where df has it) counted anew.

    Rows whose lines all go are dropped; rows that had no lines but blank ones stay as they are. Columns of any name are
    carried in a struct of their own, so none can clash.
    """
    with scratch(df.sparkSession) as kept:
        gone = line_components(df, id_col, text_col).where("not kept").groupBy("doc_id", "row_key").agg(F.collect_list("line_no").alias("gone"))
        gone = kept(materialise(gone.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "gone"), "gone"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text", F.isnull("text")))
    joined = rows.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    # what stays is told by numbers, so the work is in proportion to the lines
    split = joined.withColumn("lines", F.split("text", "\n"))
    left = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    out = split.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")))
    out = out.where(F.col("left").isNull() | F.col("left").rlike(r"\S"))
    changed = {text_col: F.coalesce("left", "text").cast(df.schema[text_col].dataType)}
    if chars_col in df.columns:
        changed[chars_col] = F.when(F.col("left").isNull(), F.col("row").getField(chars_col)).otherwise(F.length("left")).cast(df.schema[chars_col].dataType)
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))
