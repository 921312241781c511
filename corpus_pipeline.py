"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secret scans, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of docs.

Null texts, which no stage can judge, go in the first stage with texts without a letter; very long texts are read whole by every
stage; of documents that tie by doc_id the one of the least text hash stays in its component, and repeated rows count as one there;
columns of any name pass through to the last stage; empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import columns_of, filed, fresh, row_of, table
from tidestep.llm.decontaminate import without_items
from tidestep.llm.language_id import fold, kept_by_language, train
from tidestep.llm.ngram_join import ngram_join
from tidestep.llm.secret_scan import redact
from tidestep.llm.sentencepieces import encode_texts
from tidestep.storage import shared_dir

#: A document goes if no language takes up this share of its words.
LEAST_SHARE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language leads, go."""
    return kept_by_language(docs, train(docs.filter(fold(docs["doc_id"]) != 2)), LEAST_SHARE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share at least 0.8 of their five-word shingles, the one of the least doc_id stays.

    The chosen rows are known by their place in the files that docs are read from, so of exact repetitions one stays, and no key gathers them.
    """
    docs = filed(docs)
    keys = fresh(docs, "at", "hash")
    kept = ngram_join(docs, words=5, num=80, den=100).filter("kept").select(F.col("row").alias(keys[0]), F.col("text_hash").alias(keys[1]))
    own = docs.withColumns({keys[0]: row_of(docs), keys[1]: F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
    return own.join(kept, keys, "left_semi").select(*columns_of(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs)


STAGES = [("language_id", by_language), ("near_duplicates", without_near_duplicates), ("decontamination", decontaminated), ("secrets", without_secrets), ("sentencepiece", encoded)]

#: Language models, edit distances and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
