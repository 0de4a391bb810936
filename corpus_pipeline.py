"""From raw documents to packed training sequences, in five stages.

Quality rules, line deduplication, near-duplicate removal, benchmark decontamination, packing. Every
stage works on all rows that its predecessor kept, and its decisions take effect. Each stage's result is written as
Parquet and read again as the next one's documents, so a lost executor never costs more than one stage, and a lost driver neither if the run has a name.

All stages but the last return the columns that they got, under whatever names; columns beside doc_id, text, lang and n_chars decide nothing, but
no name may begin with "__tl_". An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from topiclog.llm.common import table
from topiclog.llm.components import shared_folder
from topiclog.llm.decontaminate import remove_contaminated
from topiclog.llm.line_dedup import dedup_lines
from topiclog.llm.near_copies import keep_first
from topiclog.llm.packing import pack
from topiclog.llm.quality_rules import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with references taken from all documents of the stage.

    Menu text with a symbol in every few words looks like prose to both histograms, so the stage limits symbols a word too. Null and empty
    texts fail for want of words; each row is judged alone, so rows that repeat, and null ids, are kept or go each by its text; a null lang is a language of its own.
    """
    return keep_clean(docs, symbol_limit=0.1)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that occur earlier in the corpus, and n_chars counted anew.

    Null ids come first, then ids by size; rows with one id and one text are one document and get the same text; null texts stay null.
    """
    return dedup_lines(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity of five-word shingles 0.8 or more, directly or through others.

    SimHash proposes, whole sets decide (see near_copies). The row of the smallest doc_id stays, null ids last; different texts under one id, or
    under none, are different documents; of rows with one id and one text one stays. Texts without words are one group.
    """
    return keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item; rows that repeat, and null ids, go or stay each by its text; texts without words stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of at most 1024 tokens; a text without words is its end mark alone, rows that repeat are packed each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicate),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Fingerprints and tokens are nothing that SQL can express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over the table documents; results between stages lie under the shared checkpoint folder.

    A run with a name goes on behind the last stage that it finished before, and its result stays there. A run without one begins anew, and its
    folder goes when the driver ends. Only the newest stage's files are kept.
    """
    root = f"{shared_folder(spark)}/corpus-{name or uuid.uuid4().hex}"
    jvm = spark._jvm.org.apache.hadoop.fs
    path = lambda k: jvm.Path(f"{root}/{k}")
    files = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if name is None:
        files.deleteOnExit(jvm.Path(root))
    done = max((k for k in range(len(STAGES)) if files.exists(jvm.Path(f"{root}/{k}/_SUCCESS"))), default=-1)
    docs = table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(f"{root}/{done}")
    for k, (_, stage) in list(enumerate(STAGES))[done + 1 :]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:  # nothing reads the stage before any more
            files.delete(path(k - 1), True)
    return docs
