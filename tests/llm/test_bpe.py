import copy
import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkdem.llm import bpe, registry

PATH = registry.vocab_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_are_the_tokenizers_librarys(spark, docs, tokenizer):
    rows = bpe.encode(docs, PATH, bpe.build_lexicon(docs, PATH, size=7)).collect()
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
    assert Counter((r.id, tuple(r.ids)) for r in rows) == want
    for r in bpe.round_trip(docs, PATH).collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert r.text == tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_query_over_all_documents(spark, tokenizer):
    got = {r.doc_id: r for r in registry.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(texts)
    for d in texts:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs, PATH).collect() == []


def test_decoding_broken_and_null_ids(spark, tokenizer):
    ids = tokenizer.encode("🙂", add_special_tokens=False).ids[:1]
    rows = bpe.decode(spark.createDataFrame([(1, ids), (2, None), (3, [50256])], "id long, ids array<int>"), PATH).collect()
    assert {r.id: r.text for r in rows} == {1: tokenizer.decode(ids, skip_special_tokens=False), 2: "", 3: "<|endoftext|>"}


def test_quick_pattern_agrees_with_the_full_one():
    vocab, rng = bpe.vocabulary(PATH), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab Zé'sdrel 12\n\t\x0b\x1c\x1f,.-ÿ×÷_àß") for _ in range(rng.randrange(30)))
        assert vocab._words(t) == vocab.pattern.findall(t)


def test_automaton_is_exact_and_minimal(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(7))) for _ in range(400)} | {b"x" * 300}
    data = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(sorted(words))}
    (p := tmp_path / "lex").write_bytes(bpe.compile_lexicon(data))
    lex = bpe.Lexicon(str(p))
    asked = sorted(words | {bytes(rng.choice(b"abcd") for _ in range(rng.randrange(9))) for _ in range(400)})
    for w, at in zip(asked, lex.find(asked).tolist()):
        assert (lex.ids[lex.starts[at] : lex.starts[at + 1]].tolist() if at >= 0 else None) == data.get(w)
    rights = {frozenset(v[i:] for v in words if v[:i] == w[:i]) for w in words for i in range(len(w) + 1)}
    assert len(lex.final) == len(rights)  # one state for each different set of endings


def test_word_counts_cover_all_rows(docs):
    vocab = bpe.vocabulary(PATH)
    want = Counter(w for r in docs.collect() for w in vocab.words(r.text or ""))
    assert {r.word: r.n for r in bpe.count_words(docs, PATH).collect()} == want
    assert docs.where(F.length("text") > 300_000).count() == 1


def test_letters_are_those_of_the_library():
    """Characters that are letters in a newer Unicode only, beside what splits words."""
    vocab, tool, rng = bpe.vocabulary(PATH), Tokenizer.from_file(PATH), random.Random(3)
    newer = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if bpe.newer_characters()[0][ord(c)]]
    texts = ["\U00016ec2's", "\U00018e10't", *newer[::97]]
    texts += ["".join(rng.choice([rng.choice(newer), "'s", "'t", "a", " ", "1", "é", "中", "²", "\n", "_"]) for _ in range(rng.randrange(9))) for _ in range(3000 if newer else 0)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(6)) for _ in range(5000)]
    for t in texts:
        assert [i for w in vocab.words(t) for i in vocab.merge(w)] == tool.encode(t, add_special_tokens=False).ids, ascii(t)


def test_other_vocabularies_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for name, change in (("merges", lambda s: s["model"]["merges"].reverse()), ("split", lambda s: s["pre_tokenizer"].update(type="Whitespace"))):
        other = copy.deepcopy(spec)
        change(other)
        (tmp_path / name).write_text(json.dumps(other), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / name))
