"""Token ids in binary files: each document compressed by itself with a shared zstandard dictionary.

A file holds the frames of a run of documents in ascending order, then an index, then a footer:

    frames      one zstandard frame for each document's ids, little-endian, 2 or 4 bytes each
    index       for each document: id, offset of its frame, bytes of its frame, number of ids (four little-endian int64)
    footer      offset of the index, number of documents, bytes of an id (int64 each), SHA-256 of the dictionary

The dictionary lies beside the files, under its hash. One short document is read with three short reads: footer, its
index entry, its frame. Files are written under a task's own name and then renamed, so a task can run twice; the table
of files (the manifest) names those of the tasks that counted.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdem.llm.bpe import batches_of_texts, encode_texts, vocabulary
from sparkdem.llm.common import arrow_map, hashed_sample, materialise
from sparkdem.llm.sharding import drawn_cuts, range_of

#: The dictionary is trained on this many documents, those with the least hash of id and text, and on so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 65_536
#: Bytes of text in a file, about, and files at most (beyond them they grow): their boundaries are held by the driver.
FILE_BYTES, MOST_FILES = 64 << 20, 8192
#: What a document costs beside its text.
DOC_BYTES = 64
#: Layout of the files.
ENTRY, FOOTER, NO_DICTIONARY = np.dtype([("id", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("n", "<i8")]), struct.Struct("<qqq32s"), b""
MANIFEST = "path string, n_docs long, n_ids long, first_id long, last_id long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it: the same on the driver and on executors."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def as_bytes(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def footer(at: int, n: int, width: int, digest: str) -> bytes:
    return FOOTER.pack(at, n, width, bytes.fromhex(digest))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for such samples; none (b"") if they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return NO_DICTIONARY


@functools.lru_cache(maxsize=4)
def dictionary(folder: str, digest: str) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of that hash, checked; one for each Python worker."""
    store, path = opened(f"{folder}/dictionary-{digest}.zdict")
    with store.open_input_stream(path) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path}: the dictionary isn't the one that its name says")
    return zstandard.ZstdCompressionDict(data) if data else None


def placed() -> tuple:
    """Where a document (id, text) lies in the order of files, and its size: __k, __t, __s."""
    size = (F.octet_length("text") + DOC_BYTES).cast("long")
    return F.coalesce("id", F.lit(-(2**63))).alias("__k"), F.xxhash64("text").alias("__t"), size.alias("__s")


def write_tokens(df: DataFrame, folder: str, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, writes files in ascending id order; returns the manifest in that order.

    Null and empty texts have only the end id. Rows with a null id come first (the smallest long counts as null); rows that
    repeat an id all stay, next to each other, in any order. An empty table gives an empty manifest. Files are cut by
    bytes of text, at boundaries of id and text drawn in proportion to size, so an id of many texts is several files.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = materialise(docs.select(F.xxhash64("id", "text").alias("h"), *placed()), "sizes")  # texts are read once for it
    n, total = (int(x or 0) for x in keys.agg(F.count("*"), F.sum("__s")).first())
    least = hashed_sample(keys, ["h"], SAMPLE_DOCS).select("h").distinct()
    sample = docs.join(F.broadcast(least), F.xxhash64("id", "text") == F.col("h"), "left_semi")
    vocab_size = len(vocabulary(vocab_path).bytes_of)
    width = 2 if max(vocab_size - 1, end_id) < 1 << 16 else 4

    def serialised(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for _, texts in batches_of_texts(batch):
                ids, sizes = encode_texts(texts, vocab)
                ends = np.cumsum(sizes)
                yield ([as_bytes(ids[e - s : min(e, e - s + SAMPLE_IDS)], width) for e, s in zip(ends.tolist(), sizes.tolist())],)

    samples = [bytes(r.ids) for r in arrow_map(sample, serialised, "ids binary").limit(2 * SAMPLE_DOCS).collect()]
    trained = train_dictionary(samples)
    digest = hashlib.sha256(trained).hexdigest()
    store, where = opened(folder)
    store.create_dir(where, recursive=True)
    with store.open_output_stream(f"{where}/dictionary-{digest}.zdict") as f:
        f.write(trained)

    def write(batches):
        name = uuid.uuid4().hex
        store, where = opened(folder)
        own, done = f"{where}/_{name}.tmp", f"{where}/{name}.tokens"
        shared = dictionary(folder, digest)
        press = zstandard.ZstdCompressor(level=3, dict_data=shared) if shared else zstandard.ZstdCompressor(level=3)
        vocab, entries, offset, out = vocabulary(vocab_path), [], 0, None
        for batch in batches:
            for first, texts in batches_of_texts(batch):
                out = out or store.open_output_stream(own)
                ids, sizes = encode_texts(texts, vocab)
                ends = np.cumsum(sizes)
                names = batch.column(0).slice(first, len(texts)).to_pylist()
                for i, e, s in zip(names, ends.tolist(), sizes.tolist()):
                    frame = press.compress(as_bytes(np.append(ids[e - s : e], end_id), width))
                    out.write(frame)
                    entries.append((-(2**63) if i is None else i, offset, len(frame), s + 1))
                    offset += len(frame)
        if out is None:
            return
        index = np.array(entries, ENTRY)
        out.write(index.tobytes())
        out.write(footer(offset, len(index), width, digest))
        out.close()
        store.move(own, done)
        yield [f"{folder}/{name}.tokens"], [len(index)], [int(index["n"].sum())], [int(index["id"][0])], [int(index["id"][-1])]

    files = max(1, min(MOST_FILES, total // FILE_BYTES), min(n // 1000, df.sparkSession.sparkContext.defaultParallelism * 4))
    cuts = drawn_cuts(keys.withColumn("__g", F.lit(0)), max(1, total // files), "files") or [(-(2**63), -(2**63))]
    dealt = docs.select("id", "text", *placed()).withColumn("__f", range_of(cuts))
    ordered = dealt.repartitionById(len(cuts) + 1, "__f").sortWithinPartitions("__k", "__t").select("id", "text")
    manifest = materialise(arrow_map(ordered, write, MANIFEST), "tokens")
    # one row for each file; ranges don't overlap, so the least id orders them
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("first_id", "last_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def entries_of(f, size: int) -> tuple[np.ndarray, int, str]:
    """(index, bytes of an id, hash of the dictionary) of an open file of that size."""
    f.seek(size - FOOTER.size)
    at, n, width, digest = FOOTER.unpack(f.read(FOOTER.size))
    f.seek(at)
    return np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY), width, digest.hex()


def unpress(path: str, digest: str) -> zstandard.ZstdDecompressor:
    shared = dictionary(path.rpartition("/")[0], digest)
    return zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit) of every document in the files."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, where = opened(path)
                with store.open_input_file(where) as f:
                    index, width, digest = entries_of(f, f.size())
                    tool = unpress(path, digest)
                    starts = base + np.cumsum(index["n"]) - index["n"]
                    for i in range(0, len(index), 500):
                        part = index[i : i + 500]
                        f.seek(int(part["offset"][0]))
                        data = f.read(int(part["size"].sum()))
                        cuts = (part["offset"] - part["offset"][0]).tolist()
                        ids = [tool.decompress(data[c : c + s]) for c, s in zip(cuts, part["size"].tolist())]
                        ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() if width == 2 else x for x in ids]
                        yield [None if x == -(2**63) else x for x in part["id"].tolist()], starts[i : i + 500], ids

    files = manifest.select("path", "start").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")
    return arrow_map(files, read, "id long, start long, ids binary")


def read_document(path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each that has that id) of one file, without reading the other frames."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        index, width, digest = entries_of(f, f.size())
        a, b = np.searchsorted(index["id"], [doc_id, doc_id + 1])
        found = []
        for x in index[a:b]:
            f.seek(int(x["offset"]))
            found.append(np.frombuffer(unpress(path, digest).decompress(f.read(int(x["size"]))), "<u2" if width == 2 else "<u4"))
        return found


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""
    return tokens.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
