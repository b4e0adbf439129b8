"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path
from .alignment import align_tokenizers
from .collocations import collocations, oracle as collocation_oracle
from .decontamination import contaminated_documents
from .exact_dedup import exact_dedup
from .mixing import mix_sources
from .personal_data import personal_data
from .quality import quality_scores
from .secret_scan import oracle as secret_oracle, secret_scan
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, documents, sf_dir) -> DataFrame` under a name, with SQL giving the same rows."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_suffix_dedup")
def op1(spark, docs, sf_dir):
    return suffix_dedup(docs).drop("spans")


@query("op2_secret_scan", secret_oracle())
def op2(spark, docs, sf_dir):
    return secret_scan(docs)


@query("op3_quality_scores")
def op3(spark, docs, sf_dir):
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("hash")


@query("op4_token_files")
def op4(spark, docs, sf_dir):
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path)
    return read_token_files(spark, path)


@query("op5_toxicity")
def op5(spark, docs, sf_dir):
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op6_simhash_dedup")
def op6(spark, docs, sf_dir):
    return simhash_dedup(docs).select("doc_id", "fingerprint", "component_id")


@query("op7_token_counts")
def op7(spark, docs, sf_dir):
    return token_counts(docs)


@query("op8_decontamination")
def op8(spark, docs, sf_dir):
    return contaminated_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hash")


@query("op9_mix_sources")
def op9(spark, docs, sf_dir):
    return mix_sources(docs).drop("copies", "key")


@query("op10_exact_dedup", r"""
    WITH rows AS (
      SELECT doc_id, length(coalesce(text, '')) AS n_chars,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
      FROM documents),
    hashed AS (SELECT doc_id, n_chars, norm, sha256(norm) AS text_sha256 FROM rows)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER best = 1 AS kept, text_sha256, n_chars
    FROM hashed
    WINDOW best AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)""")
def op10(spark, docs, sf_dir):
    return exact_dedup(docs)


@query("op11_personal_data")
def op11(spark, docs, sf_dir):
    return personal_data(docs)


@query("op12_collocations", collocation_oracle())
def op12(spark, docs, sf_dir):
    return collocations(docs)


@query("op13_token_alignment")
def op13(spark, docs, sf_dir):
    return align_tokenizers(docs)
