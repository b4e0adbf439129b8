"""From raw documents to token files: quality, near duplicates, decontamination, mixing, binary output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm.decontamination import decontaminate
from tradewind.llm.mixing import mixed_documents
from tradewind.llm.quality import keep_quality
from tradewind.llm.simhash import keep_one_of_each
from tradewind.llm.token_files import read_token_files, write_token_files
from tradewind.session import fresh_path, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more)."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints (4-word shingles, 4 bits), that with the smallest id."""
    return keep_one_of_each(docs, width=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and checksums, read back from the token files that were written."""
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path)
    return read_token_files(spark, path)


#: Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_files", token_files)]
#: No SQL has a discriminant, fingerprints, seeds, pivotal rounding or a tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
