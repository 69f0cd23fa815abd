"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets its rows. All stages but the last
return the columns of documents, whatever these are called. All stages take null and empty texts and null ids, and give no
rows for an empty table; what they do with ties and repeated rows is said for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdem.llm import bpe, lines, mixing, simhash, toxicity
from sparkdem.llm.common import materialise, scratch, table
from sparkdem.llm.registry import vocab_path

#: A text is rejected at this score; passes over a source at most; words in a near-duplicate's shingle, and its least
#: Jaccard similarity.
TOXIC, MOST_PASSES, WORDS, SIMILARITY = 0.3, 1.25, 5, 0.8


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxic score go, whatever their label. The model is fitted on labelled rows of the documents. Null and
    empty texts aren't toxic, unless all labelled rows are; equal texts have equal scores, so they stay or go together."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of fuzzy lines stays; documents of which no line stays go. Null texts, and texts of blank
    lines only, stay as they are. The first line in the order of doc_id (null first), text and place stays; rows that repeat
    id and text keep the same lines, so they stay repeated."""
    return lines.drop_duplicate_lines(docs)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: fingerprints of five-word shingles at three bits or fewer,
    or sets of these shingles at a Jaccard similarity of 0.8 or more. It is the one of the smallest id (null last), of equal
    ids the text of the smallest hash, and of repeated rows one. Null and empty texts are near-duplicates of each other."""
    return simhash.keep_representatives(docs, words=WORDS, similarity=SIMILARITY)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is kept once, and again as often as its source's tempered weight asks, up to MOST_PASSES passes. Rows
    that share an id (null is one) are drawn together, under the least source among them. A null source is a source, and
    texts without words cost nothing, so they are kept in each pass that is reached."""
    counted = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return mixing.mix_rows(docs, mixing.mix(counted, "doc_id", max_repeats=MOST_PASSES), "doc_id")


def texts_are_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, checked by decoding: doc_id, n_tokens and digests of the ids and of the decoded text. A row for each row,
    repeated ones too; null and empty texts have no ids."""
    ids = bpe.round_trip(docs, vocab_path())
    return ids.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", repeated_lines_go),
    ("simhash_dedup", near_duplicates_go),
    ("mixing", sources_are_mixed),
    ("encoding", texts_are_encoded),
]

#: SQL has neither the fitted model nor the vocabulary's merges; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again. What else a stage
    writes is deleted when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(materialise(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
