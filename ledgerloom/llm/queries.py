"""The operators' queries over the driver's tables: each runs one operator with production parameters over its
whole table and derives the digest columns of the result from the operator's output."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import ensure_checkpoint_dir
from . import chat, decontaminate, fill_middle, knn, language_id, ngram_join, packing, rans, sharding, tokens, url_filter, vector_codes, warc

TOKENIZER = "byte_bpe_50k.json"
CONFLICT = "<|im_end|><|im_start|>assistant ok"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TOKEN_LIMIT = 1024
SHARDS = 16


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into 2048-token sequences."""
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", _bytes("text").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, and what reading the formatted text back gives."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    done = chat.format_chats(turns)
    read = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                       F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url. A page's label is that of the document with its number: bad when toxic or of low quality."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    judged = url_filter.judge_urls(pages, pages.join(labels, "page_id").select("url", "bad"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector among all others, components as floor(256 x)."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(
        F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    vectors = vectors.select("vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("vector"))
    found = knn.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word benchmark windows in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.array_join(names, ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 16 shards of near equal bytes; equal texts stay together as far as the sizes allow."""
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", (_bytes("text") + 1).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("key"))
    dealt = sharding.shard_by_size(docs, "size", "key", SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back: full payloads of responses, headers only of revisits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    warc.write_archives(warc.page_records(_read(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    page = F.col("headers")["X-Page-Id"].cast("long").alias("page_id")
    refers = F.regexp_extract("refers_to", "^<urn:page:(.*)>$", 1).cast("long")
    full = warc.read_archives(spark, path).where("record_type = 'response'")
    full = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
                       "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(page, F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"),
                         F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", refers.alias("refers_to"))
    return full.unionByName(again)


def op11_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as rANS files in id order, and what reading these back gives."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    rans.write_token_ids(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER), path, end_id=2)
    return rans.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts of every vector, their errors, and the codebooks' digest."""
    coded, books = vector_codes.encode_vectors(_read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return vector_codes.label_errors(coded).select(F.col("id").alias("vec_id"), vector_codes.hex_code("codes").alias("code"), "error", "label_error",
                                                   F.lit(books.sha256).alias("codebooks_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in fill-in-the-middle form, and the texts rebuilt from that."""
    made = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_middle.restore("output", "form")).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard, op3_token_counts, op4_chat_format, op5_url_filter, op6_topk_search,
                                   op7_decontaminate, op8_sharding, op9_language_id, op10_warc, op11_rans_ids, op12_vector_codes,
                                   op13_fill_middle, pipeline)}
