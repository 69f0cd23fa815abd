import math
import random
import re
import zlib

from sparkdem.llm import registry, toxicity

TERMS = [("idiot", False), ("scum", False), ("lowei", True), ("worthless", False)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_plain_distances():
    rng, matcher = random.Random(1), toxicity.Matcher(TERMS)
    for _ in range(6000):
        word = list(rng.choice(TERMS)[0])
        for _ in range(rng.randrange(4)):
            word[rng.randrange(len(word) + 1) : rng.randrange(len(word) + 1)] = rng.choice(["", "x", "i", "ot"])
            word = word or ["s"]
        word = "".join(word)
        exact = [i for i, (t, stem) in enumerate(TERMS) if not stem and t == word]
        stem = [i for i, (t, s) in enumerate(TERMS) if s and word.startswith(t)]
        fuzzy = [i for i, (t, s) in enumerate(TERMS) if not s and len(t) >= 5 and distance(t, word) == 1]
        want = (exact[0], "exact") if exact else (stem[0], "stem") if stem else (fuzzy[0], "fuzzy") if fuzzy else None
        assert matcher.find(word) == want, word


def test_context_tells_quotation_from_abuse():
    scan = toxicity.Scanner({"terms": TERMS, "evidence": [1.0] * 4, "ordinary": ["idiom"], "exact_only": ["worthless"]})
    (abuse,), _ = scan.hits("you are an IDI0T and your friends know")
    (quote,), _ = scan.hits('the report said that the word "idiot" was old')
    assert abuse[2:5] == (0, "fuzzy", 2) and abuse[5] == 0 and quote[3] == "exact" and quote[4] == 0 and quote[5] == 4
    assert scan.hits("an idiom, worthles")[0] == [] and scan.hits("")[1] == 0
    assert scan.hits("an idiom")[0] == [] and scan.hits("") == ([], 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in registry.op8_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9 and hit / sum(p for p, _ in held) > 0.9


def test_edge_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (1, None, None), (None, 1, 1), (4, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for chosen in (labels, labels.where("toxic = 1"), labels.where("false")):
        model = toxicity.train(docs, chosen)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        kept = toxicity.keep_clean(docs, model, 0.3)
        assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in rows)
        assert toxicity.score(no_docs, model).collect() == [] and toxicity.keep_clean(no_docs, model).collect() == []
    assert toxicity.train(no_docs, labels)["terms"] == []


def plain_score(text, model):
    """A text's score from the model's terms and weights, word by word and term by term."""
    low = text.lower()
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+(?:[*@$!#][^\W_]+)*", low)]
    terms = model["terms"]

    def match(word):
        if word in model["ordinary"]:
            return None
        same = [i for i, (t, stem) in enumerate(terms) if not stem and t == word]
        begins = [(len(t), i) for i, (t, stem) in enumerate(terms) if stem and word.startswith(t)]
        near = [i for i, (t, stem) in enumerate(terms) if not stem and len(t) >= 5 and t not in model["exact_only"]]
        fuzzy = [i for i in near if abs(len(terms[i][0]) - len(word)) <= 1 and distance(terms[i][0], word) == 1]
        fuzzy = fuzzy or [i for i in near for k in range(len(terms[i][0]) - 1) if word == (t := terms[i][0])[:k] + t[k + 1] + t[k] + t[k + 2 :]]
        if same or begins or fuzzy:
            return (same[0], 1) if same else (min(begins)[1], 2) if begins else (fuzzy[0], 3)
        for k in range(4 if len(word) == 4 else 0):
            for i, (t, stem) in enumerate(terms):
                if not stem and len(t) == 4 and t not in model["exact_only"] and t[:k] + t[k + 1 :] == word[:k] + word[k + 1 :] and (word[k] in "*@$!#0123456789" or (t[k], word[k]) in toxicity.LOOKALIKES):
                    return i, 3
        return None

    evidence, hits, address, quotes = {1: 0.0, 2: 0.0, 3: 0.0}, 0, 0, 0
    for n, (_, _, word) in enumerate(found):
        if hit := match(word):
            around = [found[k] for k in range(max(0, n - 6), min(len(found), n + 7)) if k != n]
            every = [*around, found[n]]
            evidence[hit[1]] += model["evidence"][hit[0]]
            hits += 1
            address += sum(w in toxicity.ADDRESS for _, _, w in around)
            quotes += sum(w in toxicity.REPORT for _, _, w in around) + sum(c in "\"“”„«»‘’" for c in low[min(a for a, _, _ in every) : max(b for _, b, _ in every)])
    x = [1.0, *(math.log1p(evidence[k]) for k in (1, 2, 3)), float(hits > 0), hits / max(1, len(found)), math.log1p(address), math.log1p(quotes)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["weights"]))))


def test_scores_against_a_plain_reading_of_the_model(spark, docs):
    sf = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(table, labels)
    assert any(stem for _, stem in model["terms"]) or len(model["terms"]) > 3
    odd = "an IDIOT, idoit said «idi0t» sc*m scvm; you are w0rthless idiotic", "the word “scum” quoted"
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = table.select("doc_id", "text").unionByName(extra).unionByName(docs.select("doc_id", "text").where("doc_id <> 4"))
    got = sorted((r.id is not None, r.id or 0, r.score) for r in toxicity.score(every, model).collect())
    want = sorted((r.doc_id is not None, r.doc_id or 0, plain_score(r.text or "", model)) for r in every.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9, (a, b)


def test_what_is_beyond_the_bounds_is_told(spark):
    sf = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    whole = toxicity.train(table, labels)
    few = toxicity.train(table, labels, most_terms=1)
    assert whole["cut"] == {"terms": 0, "ordinary": 0} and few["cut"]["terms"] > 0
