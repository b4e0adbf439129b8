"""Exact duplicates by a sort of the contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, id_and_text


def normalised(text: Column) -> Column:
    """The text without ASCII white space; equal normalised texts are duplicates."""
    return F.regexp_replace(text, SPACE, "")


def _runs(batches):
    """Walk rows sorted by content; compare each text with its neighbour and hash every run once."""
    import hashlib

    import pyarrow as pa

    last, digest = None, ""
    for batch in batches:
        ids, sizes, texts = (batch.column(i) for i in range(3))
        digests, first = [], []
        for start in range(0, batch.num_rows, 512):
            for text in texts.slice(start, 512).to_pylist():
                new = text != last
                if new:
                    last, digest = text, hashlib.sha256(text.encode()).hexdigest()
                digests.append(digest)
                first.append(new)
        yield pa.RecordBatch.from_arrays(
            [ids, sizes, pa.array(digests, pa.string()), pa.array(first, pa.bool_())],
            names=["doc_id", "n_chars", "text_sha256", "first"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are equal without ASCII white space. Of equal texts the row with the most
    code points in its original text stays, then the smallest id.

    Content sort: rows are range-partitioned by sampled splitters over (first `prefix` characters of the
    normalised text, its 64-bit hash, id) and sorted by them within partitions (spilling if need be), which
    puts equal texts next to each other; neighbours are compared in full and each run of equal texts is
    hashed once. The prefix keeps the sampled splitters small whatever the texts are. As the id closes the
    sort key, the splitters cut a large group of copies over several partitions like any other range; its
    runs meet again by the SHA-256 of the text in an aggregation that combines before it shuffles.

    Nothing is written in between: both uses of the runs read the same range shuffle and sort it again, which costs
    less than files of their own for every partition. Groups are added up by the digest's bytes and joined by its text,
    so that the join shuffles both of its sides itself and can split the partition of a large group.

    Null texts count as empty, and all empty texts are equal. A null id counts as the smallest. Rows that
    repeat an id are rows of their own; all of those with the kept id and text count as kept. An empty table
    gives no rows. Columns other than id and text are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    keys = [F.substring("norm", 1, prefix), F.xxhash64("norm"), F.col("doc_id")]
    ids = rows.schema["doc_id"].dataType.simpleString()
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _runs, f"doc_id {ids}, n_chars long, text_sha256 string, first boolean")
    groups = runs.groupBy(F.unhex("text_sha256").alias("digest")).agg(
        F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").alias("id"))).alias("best"),
        F.count("*").alias("group_size"))
    best = groups.select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("best.id").alias("keep_id"),
                         (-F.col("best.size")).alias("keep_chars"), "group_size")
    return runs.join(best, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256", "n_chars")
