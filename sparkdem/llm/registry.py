"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdem.llm import ann, bpe, chat, lines, mixing, negatives, ogg, packing, resampling, sharding, simhash, tokenfile, toxicity
from sparkdem.llm.common import shared_dir, table


def vocab_path() -> str:
    """Where the byte-level vocabulary lies; LLM_VOCABULARY overrides the installed one."""
    if "LLM_VOCABULARY" in os.environ:
        return os.environ["LLM_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), vocab_path())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder, vocab_path(), end_id=0)
    return tokenfile.checksums(tokenfile.read_tokens(spark, manifest))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.to_media(table(spark, sf_dir, "documents"))
    back = ogg.from_media(media.select("id", "media")).select(F.col("id").alias("doc_id"), "n_bytes", "payload", "feature", "streams", "seconds", "error", "media_bytes", "media_sha256")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "streams",
        "seconds",
        "error",
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\\### Assistant: </turn> ok"
    extra = spark.sql(f"select -7L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(chats))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_components(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "component_id", "kept")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.train(docs, labels.where(fold != 2))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return mixing.mix(docs, "doc_id", max_repeats=2.0).withColumnRenamed("key", "doc_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocab_path(), window=1024, end_id=0)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label, positives=5, negatives=5, band=(80, 100), scale=256)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wanted = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = resampling.resample(docs, wanted, lambda n: 10 * n // 100, buckets=10_000, run=1, min_words=20, seed=2024)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_lines": op3_lines,
    "op4_ann": op4_ann,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_ogg": op7_ogg,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_chat": op10_chat,
    "op11_packing": op11_packing,
    "op12_negatives": op12_negatives,
    "op13_resampling": op13_resampling,
}
#: Lengths count code points; a block begins where the role changes.
CHAT_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as begins,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) as text_chars, length(replace(replace(role, '\', '\\'), '<|', '<\|')) as role_chars
  from said
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_chars + case when begins then role_chars + length('<|start|><|text|><|end|>') + 1 else length('<|sep|>') end) as bigint) as formatted_chars
from placed group by conv_id
"""
NEGATIVES_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id as id, cast(list_dot_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where alike
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank, id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not alike and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5
"""
#: The checksum of each different word is made from a table of the 256 bytes' checksums.
RESAMPLING_SQL = r"""
with recursive step as (
  select i as byte, i as c, 0 as k from range(256) t(i)
  union all select byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8
), bytes as (
  select list(c order by byte) as crc from step where k = 8
), said as (
  select 1 as kind, row_number() over () as row, doc_id, text from documents union all select 0, row_number() over (), null, text from benchmark
), worded as (
  select kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from said
), placed as (
  select kind, row, unnest(words) as word from worded
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(word))),
      lambda i: cast(instr('123456789ABCDEF', hex(encode(word))[2 * i + 1]) * 16 + instr('123456789ABCDEF', hex(encode(word))[2 * i + 2]) as bigint))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct word from placed), bytes
), counted as (
  select bucket, count(*) filter (kind = 1) as s, count(*) filter (kind = 0) as t from placed join hashed using (word) group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln((t + 1)::double * ((select sum(s) from counted) + 10000)::double / ((s + 1)::double * ((select sum(t) from counted) + 10000)::double))) as bigint) as gain from counted
), summed as (
  select row, count(*) as n, cast(sum(gain) as bigint) as total from placed join hashed using (word) join gains using (bucket) where kind = 1 group by row
), scored as (
  select row, doc_id, coalesce(n, 0) as n_features, cast(coalesce((total - ((total % n) + n) % n) // n, 0) as bigint) as weight,
    cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as noise
  from worded left join summed using (row) where kind = 1
), ranked as (
  select *, row_number() over (order by n_features < 20, weight + noise desc, doc_id nulls first) as r from scored
)
select doc_id, n_features, weight, weight + noise as score, case when n_features >= 20 and r <= 10 * (select count(*) from scored where n_features >= 20) // 100 then r end as rank from ranked
"""
ORACLES: dict[str, str] = {"op10_chat": CHAT_SQL, "op12_negatives": NEGATIVES_SQL, "op13_resampling": RESAMPLING_SQL}
