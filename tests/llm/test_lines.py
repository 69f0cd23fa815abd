import random

from pyspark.sql import functions as F

from sparkdem.llm import lines, registry

K = lines.SHINGLE


def plain(rows):
    """{(doc_id, line number): (representative, kept)} by comparing all lines. rows: (doc_id, text), in order."""
    found = [(d, i, x.strip(" \t\r\x0b\x0c")) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    found = [f for f in found if f[2]]
    texts = sorted({f[2] for f in found})
    sets = {t: {t[i : i + K] for i in range(len(t) - K + 1)} for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x) >= 0.8 * len(y) and len(y) >= 0.8 * len(x) and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    first = {}
    for d, i, t in found:
        first.setdefault(find(t), (d, i))
    return {(d, i): (first[find(t)], first[find(t)] == (d, i)) for d, i, t in found}


def grouped(rows):
    """The same from the operator's rows."""
    first = {r.component_id: (r.doc_id, r.line_no) for r in rows if r.kept}
    assert len(first) == sum(r.kept for r in rows)
    return {(r.doc_id, r.line_no): (first[r.component_id], r.kept) for r in rows}


def test_query_against_all_pairs(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(40)) for _ in range(6)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n in range(200):  # variants of a few lines, one word changed
        line = rng.choice(base).split(" ")
        line[rng.randrange(40)] = "changed"
        rows.append((10_000 + n, f"short\n  {' '.join(line)} \n\n{rng.choice(base)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = grouped(registry.op3_lines(spark, str(tmp_path)).collect()), plain(sorted(rows))
    assert got.keys() == want.keys()
    assert all(want[k][0] == want[v[0]][0] for k, v in got.items())  # nothing is joined that isn't alike
    assert sum(got[k] == want[k] for k in want) >= 0.985 * len(want)
    assert sum(not kept for _, kept in want.values()) > 300


def test_edge_rows(docs, no_docs):
    rows = lines.line_components(docs).collect()
    assert len({(r.doc_id, r.line_no) for r in rows}) == len(rows) and {r.doc_id for r in rows} == {0, 1, 4, 5, None, 7, 8}
    assert lines.line_components(no_docs).collect() == []
    out = lines.drop_duplicate_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert lines.drop_duplicate_lines(no_docs).collect() == []
    assert {r.doc_id for r in out.collect()} >= {0, 2, 3, 4, 5, 7, 8, 9, None}


def test_lines_go_and_documents_stay(spark):
    same = "this line is in both of the documents, word for word, and it is long enough for one letter not to matter, or so one hopes"
    near = same.replace("letter", "lettor")
    df = spark.createDataFrame([(1, f"a first line\n{same}\nend", 0), (2, f"{near}\n\nother text of its own", 0), (3, same, 0), (4, "\n \n", 3)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.drop_duplicate_lines(df).collect()}
    assert got == {1: (f"a first line\n{same}\nend", 0), 2: ("\nother text of its own", 22), 4: ("\n \n", 3)}
