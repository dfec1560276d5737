"""A training corpus from raw documents, in four stages, each one operator of ``ledgerloom.llm``:

1. language_id: documents without a recognisable language (null, empty, no letters) go; every text with a letter
   stays, whatever its score, as no score tells junk from short clean texts (figures in the README), and its ``lang``
   becomes the language found in the text, whatever label it came with. Where no document carries a label there
   is nothing to learn from, and the texts with a letter stay as they are;
2. near_duplicates: of each group of documents linked by 5-word shingle sets of Jaccard similarity 0.8 or
   more, the one with the smallest id stays;
3. decontamination: documents that hold a 10-word window of a benchmark item go;
4. packing: what is left is tokenised and packed into sequences of 2048 tokens, each of one language of stage 1.

Every stage works on all its predecessor kept, which is written as Parquet under ``spark.checkpoint.dir`` and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, ngram_join, packing
from ledgerloom.sources.snapshot import materialize

#: SQL can't tokenise, nor score a kernel model; tests/llm holds the stages against brute force.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language, ``lang`` being the one found; the model learns from the documents that
    carry a label. Without any label the documents with a letter stay as they are.
    """
    return language_id.keep_identified(docs, language_id.train(docs), lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without any benchmark window."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents", n=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences, which don't mix languages."""
    packed = packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0, kind_col="lang")
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "lang")


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
