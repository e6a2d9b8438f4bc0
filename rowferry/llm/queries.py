"""One registered query for each operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import bpe, idstore, importance, langid, merkle, neighbours, packing, pieces, pii, rules, simhash, warc, whitening
from rowferry.scratch import materialize, scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.resolved(warc.read_archives(spark, path, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "padded_length",
    )


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    idstore.write_ids(_table(spark, sf_dir, "documents"), path, WORD_BPE)
    read = idstore.read_shards(spark, path).select(
        "shard", "block", "doc_id", "block_start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    read = materialize(read, "ids-read")
    bases = idstore.starts(read.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n_ids")))
    return read.join(bases, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"), "spans"
    )


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(_table(spark, sf_dir, "documents")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), PIECE_BPE).select(
        "doc_id", "ids", F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256")
    )
    return pieces.decode(encoded, PIECE_BPE).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        "spans_sha256",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_byte_bpe, op3_nearest, op4_packing, op5_id_store,
        op6_language, op7_pii, op8_importance, op9_rules, op10_simhash,
        op11_merkle, op12_sentencepiece, op13_whitening,
    )
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {i}, 5))::bigint >> {s}) & 31)::int + 1, 1)"
    for i in range(1, 41, 5)
    for s in (15, 10, 5, 0)
)

ORACLES: dict[str, str] = {
    "op1_warc": f"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
        r as (select page_id, strlen(html)::bigint as payload_bytes, {_BASE32} as payload_digest,
                max(page_id) over (partition by h) as original,
                row_number() over (partition by h order by page_id desc nulls last) as nth from p)
        select page_id, payload_bytes, payload_digest,
          case when nth = 1 then 'response' else 'revisit' end as record_type,
          case when nth > 1 then original end as refers_to
        from r""",
    "op3_nearest": """
        with v as (select vec_id, embedding::double[] as e from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op9_rules": rules.SQL,
    "op11_merkle": merkle.SQL,
}
