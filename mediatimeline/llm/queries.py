"""The registered queries of these operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mediatimeline.llm import bpe, centroids, fingerprints, html_extract, jaccard_join, language_id, license_scan, mixing, phrases, quality_rules, records, sharding, token_counts
from mediatimeline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_sharding(spark, folder):
    return sharding.shard(read(spark, folder, "documents"))


@query()
def op2_token_counts(spark, folder):
    return token_counts.token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op3_license_scan(spark, folder):
    return license_scan.license_scan(read(spark, folder, "documents"))


@query()
def op4_mixing(spark, folder):
    return mixing.mix(read(spark, folder, "documents"))


@query()
def op5_quality_rules(spark, folder):
    return quality_rules.quality_rules(read(spark, folder, "documents"))


@query(fingerprints.SQL)
def op6_fingerprints(spark, folder):
    return fingerprints.fingerprints(read(spark, folder, "documents"))


@query()
def op9_jaccard_join(spark, folder):
    return jaccard_join.jaccard_components(read(spark, folder, "documents"))


@query()
def op10_bpe(spark, folder):
    return bpe.encode(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, digest=True)


@query()
def op7_html_extraction(spark, folder):
    return html_extract.extract(read(spark, folder, "pages"))


@query()
def op8_language_id(spark, folder):
    return language_id.language_id(read(spark, folder, "documents"))


@query(centroids.sql())
def op13_centroids(spark, folder):
    return centroids.centroid_clusters(read(spark, folder, "embeddings")).drop("compared")


@query()
def op12_records(spark, folder):
    return records.records(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(phrases.sql())
def op11_phrases(spark, folder):
    return phrases.collocations(read(spark, folder, "documents"))
