"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where rows are keyed by id and hash of the text.
NO_ID = -2 ** 63


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column of the caller can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def packed_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """The documents with all their columns in one struct `row`, beside key columns that so cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[key.alias(name) for name, key in keys.items()])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks share loaded vocabularies.

    Functions travel to the workers by value; their globals are fresh in every task, this module is not.
    """
    name = "_tradewind_worker_cache"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.cache = {}
        sys.modules[name] = module
    return sys.modules[name].cache


def slices(batches, rows: int = 512):
    """Record batches cut to a few rows each, so that the Python objects of one step stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def vocabulary_path(name: str) -> str:
    """Where the worker finds a vocabulary: an absolute path as it is, else a file of the installed package."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
