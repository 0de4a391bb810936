"""The operators' queries over the driver's tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclog.llm import oracle
from topiclog.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.secret_scan import scan, trained

    return scan(table(spark, sf_dir, "documents"), trained(public_tokenizers.path("byte_bpe_50k.json")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.quality_rules import judged

    rules = judged(table(spark, sf_dir, "documents"))
    return rules.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.line_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topiclog.llm.url_filter import filter_urls, page_labels

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}

#: DuckDB SQL for the operators that SQL can express.
ORACLE: dict[str, str] = {
    "op4_quality_rules": oracle.quality_rules(),
    "op5_decontamination": oracle.OP5,
    "op6_license_scan": oracle.license_scan(),
    "op8_line_dedup": oracle.OP8,
    "op10_url_filter": oracle.url_filter(),
}
