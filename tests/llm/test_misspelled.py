from sparkdem.llm import toxicity

FAMILY = ["idiot", "idiots", "idiotic"]


def test_misspelled_terms_are_found(spark):
    rows = [(f"you are {('an ' + FAMILY[i % 3]) if i % 2 else 'scum'} and stupid w{i}a", 1) for i in range(300)] + [(f"a day in the garden with w{i}b", 0) for i in range(2000)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    stems = [t for t, stem, _ in terms if stem]
    assert any("idiot".startswith(s) for s in stems)  # no word makes up most of it
    model = {"terms": [t[:2] for t in terms], "evidence": [t[2] for t in terms], "exact_only": [], "ordinary": ["scam"]}
    scan = toxicity.Scanner(model)
    want = {"1diot": "idiot", "ldiots": "idiots", "idoit": "idiot", "idoitic": "idiotic", "scvm": "scum", "sc*m": "scum", "5cum": "scum", "sutpid": "stupid", "stupdi": "stupid", "st*pid": "stupid"}
    for word, term in want.items():
        (hit,) = scan.hits(f"garden {word} garden")[0]
        assert (model["terms"][hit[2]][0], hit[3]) == (term, "fuzzy"), word
    for word in ("scam", "slum", "scu", "scums", "csum", "stdipu", "garden"):
        assert scan.hits(f"garden {word} garden")[0] == [], word
    assert toxicity.Scanner(model | {"exact_only": ["scum", "stupid"]}).hits("scvm sc*m sutpid stupod")[0] == []
