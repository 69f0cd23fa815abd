import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkdem.llm import registry, tokenfile
from sparkdem.llm.common import shared_dir

PATH = registry.vocab_path()


def wanted(rows):
    tool, start, out = Tokenizer.from_file(PATH), 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, registry.op6_token_files(spark, "/root/testdata/sf0.001").collect())) == wanted(docs)


def test_edge_rows_and_short_reads(spark, docs, no_docs):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = tokenfile.write_tokens(docs, folder, PATH)
    got = sorted(map(tuple, tokenfile.checksums(tokenfile.read_tokens(spark, manifest)).collect()), key=lambda r: r[1])
    assert got == wanted(docs.collect())
    paths = [r.path for r in manifest.collect()]
    found = [x for p in paths for x in tokenfile.read_document(p, 5)]
    assert len(found) == 2 and all(x.tolist() == [*Tokenizer.from_file(PATH).encode("one").ids, 0] for x in found)
    none = tokenfile.write_tokens(no_docs, folder + "-none", PATH)
    assert none.collect() == [] and tokenfile.read_tokens(spark, none).collect() == []


def test_a_foreign_dictionary_is_refused(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the of and number ', id, ' is in the ', id * 7) as text")
    manifest = tokenfile.write_tokens(docs, str(tmp_path / "files"), PATH)
    (name,) = (tmp_path / "files").glob("*.zdict")
    assert name.stat().st_size > 0
    assert tokenfile.read_tokens(spark, manifest).count() == 3000
    name.chmod(0o644)
    name.write_bytes(b"other")
    tokenfile.dictionary.cache_clear()
    with pytest.raises(ValueError):
        tokenfile.read_document(manifest.first().path, 1)
    assert tokenfile.train_dictionary([b"a"]) == b""


def test_the_type_of_the_id_changes_nothing(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the of and number ', id, ' is in the ', id * 7) as text")
    for kind in ("int", "bigint"):
        tokenfile.write_tokens(docs.withColumn("doc_id", docs.doc_id.cast(kind)), str(tmp_path / kind), PATH)
    a, b = (next((tmp_path / kind).glob("*.zdict")).read_bytes() for kind in ("int", "bigint"))
    assert a == b and a


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Long documents at one end, and an id that many texts share: files have about as many bytes."""
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 40_000)
    text = "concat('word ', xxhash64(id) % 1000, repeat(' the and of it', if(id < 300, 60, 2)))"
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 1000, id) as doc_id", f"{text} as text")
    manifest = tokenfile.write_tokens(docs, str(tmp_path / "files"), PATH).collect()
    sizes = [r.n_ids for r in manifest]
    assert len(sizes) > 5 and max(sizes) < 4 * sum(sizes) / len(sizes)
    assert sum(r.first_id == r.last_id == 1000 for r in manifest) >= 2  # one id of a third of all rows is several files
    rows = sorted(((r.first_id, r.last_id, r.start, r.n_ids) for r in manifest), key=lambda r: r[2])
    at, last = 0, -1
    for first, end, start, n in rows:
        assert start == at and first >= last
        at, last = start + n, end
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.checksums(tokenfile.read_tokens(spark, spark.createDataFrame(manifest))).collect())
    assert got == sorted((i, n, c) for i, _, n, c in wanted(docs.collect()))
