import random

import pytest
from pyspark.sql import functions as F

from sparkdem.llm import lines
from tests.llm.test_lines import grouped, plain

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def test_pairs_of_similarity_0_8_are_found(spark):
    """Lines of 20 to 400 shingles whose last ninth differs: a Jaccard similarity of just 0.8 or more. None else is joined."""
    rng, rows, sizes = random.Random(7), [], (20, 40, 60, 110, 125, 160, 400)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    for n in sizes:
        for _ in range(150):
            a = word(n + lines.SHINGLE - 1)
            rows += [(n, a), (n, a[: -(n // 9)] + word(n // 9))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in lines.line_components(df).collect()}
    shares = {}
    for i in range(0, len(rows), 2):
        shares.setdefault(rows[i][0], []).append(found[i] == found[i + 1])
    assert {n: sum(x) / len(x) for n, x in shares.items()}.keys() == set(sizes) and min(sum(x) / len(x) for x in shares.values()) >= 0.95, shares
    assert len(set(found.values())) == len(rows) - sum(map(sum, shares.values()))


def test_repetitive_lines_of_any_length_are_one(spark):
    rows = [(i, "the " * n + "the") for i, n in enumerate((4, 20, 40, 60, 200, 2000))] + [(9, "the of " * 50)]
    found = {r.doc_id: r.component_id for r in lines.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({found[i] for i in range(6)}) == 1 and found[9] != found[0]


@pytest.mark.parametrize("hot", [1000, 20])
def test_one_group_of_half_alike_lines(spark, monkeypatch, hot):
    """Lines that share a passage, on both sides of 0.8; with a small bound their buckets are split."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(8)
    passage = "".join(rng.choice(LETTERS) for _ in range(150))
    rows = [(i, passage + "".join(rng.choice(LETTERS) for _ in range(rng.choice([8, 16, 17, 20, 60, 120])))) for i in range(150)]
    got, want = grouped(lines.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), plain(rows)
    assert all(want[k][0] == want[v[0]][0] for k, v in got.items())
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.95 * len(want) and sum(not kept for _, kept in want.values()) > 20


def test_near_copies_are_joined_before_all_pairs_are_held(spark, monkeypatch):
    """Copies of one line with one to four letters changed: five changes or fewer between two of them are a similarity of 0.8."""
    rng, found, all_apart = random.Random(9), [], lines.all_apart

    def counted(named, maps):
        found.append(all_apart(named, maps).count())
        return all_apart(named, maps)

    monkeypatch.setattr(lines, "all_apart", counted)
    line = [rng.choice(LETTERS) for _ in range(400)]
    rows = []
    for i in range(300):
        copy = list(line)
        for at in rng.sample(range(10, 390), rng.choice([1, 2, 3, 4, 4, 4])):
            copy[at] = "-"
        rows.append((i, "".join(copy)))
    got, want = grouped(lines.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), plain(rows)
    assert got == want and sum(not kept for _, kept in want.values()) == 299
    assert sum(found) < 300, found


def test_lines_that_share_a_hash_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "first_hash", lambda: F.pmod(F.xxhash64("line"), F.lit(50)))
    rows = [(i, f"{i % 300} a line of its own, number {i % 300 * 7919}") for i in range(600)]
    found = {r.doc_id: (r.component_id, r.kept) for r in lines.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(found[i][0], set()).add(t)
    assert all(found[i][0] == found[i + 300][0] and not found[i + 300][1] for i in range(300))
    assert max(map(len, texts.values())) <= 3  # only lines one letter apart are joined, not those of one hash


def test_other_columns_are_carried(spark):
    rows = [(1, "one line", 5, "k"), (2, "one line\nother", 5, "k"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, gone long, `left` string")
    out = lines.drop_duplicate_lines(df)
    assert out.schema == df.schema or [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "one line", 5, "k"), (2, "other", 5, "k"), (None, None, None, None)], key=str)


def test_lines_are_signed_once_for_each_number_of_draws(spark, monkeypatch):
    """Lines at the least length of a number of draws fill few cells by it; they were signed again, by what they had already. And
    the lines of all numbers of draws were dealt by one statement. Lines that repeat themselves still meet short ones."""
    rng, written, materialise = random.Random(10), [], lines.materialise
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    rows = [word(n + lines.SHINGLE - 1) for n in [20] * 10 + list(range(36, 46)) * 10 + list(range(112, 141)) * 5 + [300] * 10]
    whole, period = len(rows), [word(40) for _ in range(20)]
    rows += [p + p[: lines.SHINGLE - 1] for p in period] + [(4 * p)[: 127 + i] for i, p in enumerate(period[:10])] + [9 * p for p in period[10:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in lines.line_components(df).collect()}
    assert all(got[whole + i] == got[whole + 20 + i] for i in range(20)) and len(set(got.values())) == whole + 20
    found = materialise(lines.occurrences(lines.keyed(df.where(F.col("doc_id") < whole), "doc_id", "text")), "lines")
    monkeypatch.setattr(lines, "materialise", lambda df, name, *a: written.append((name, out := materialise(df, name, *a))) or out)
    keys = lines.signatures(found, lines.classes_of(found)).groupBy("h").count().collect()
    assert sorted(r["count"] for r in keys) == [lines.BANDS] * 20 + [2 * lines.BANDS] * (whole - 20)
    assert [t.select("h").distinct().count() for n, t in written if n == "signatures"] == [155, 245, 110]
