"""Benchmark passages in documents, found by spaced seeds and verified token by token."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import NO_ID, id_and_text, slices

#: 1 is a token that must agree, 0 one that may differ. The masks differ in rhythm, so that a
#: substitution that breaks one of them at every place leaves another whole.
MASKS = ("1111011", "110110111", "1011100111", "11101011")
#: By the tokens of an item (or window) under 20, what the masks above need so that every choice of up to a fifth of the
#: tokens, substituted, leaves one mask whole at some place. Lengths that are not listed need nothing.
SHORT_MASKS = {5: ("1111", "10111", "11011", "11101"), 6: ("1111", "11011"), 7: ("11111", "110111"),
               8: ("111111", "11011111"), 10: ("11111", "1100111"),
               **dict.fromkeys((11, 12, 15, 16, 17), ("11000010111",))}
LEAST = 5  # tokens of the shortest item that is looked for
WINDOW = 20  # tokens from which the fixed masks find every window alone
CACHED_WORDS = 1_000_000
RUN_TOKENS = 1 << 15  # tokens whose seeds are made in one step


class WordHashes(dict):
    """The hash of a word without its punctuation, 0 if nothing is left; at most CACHED_WORDS are remembered."""

    def __init__(self):
        import re

        import xxhash

        super().__init__()
        self._hash, self._strip = xxhash.xxh64_intdigest, re.compile(r"[\W_]+").sub

    def __missing__(self, word: str) -> int:
        bare = word if word.isalnum() else self._strip("", word)
        value = (self._hash(bare.encode()) or 1) if bare else 0
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


def token_hashes(text: str, known: WordHashes) -> list[int]:
    """A hash for each token: the words between white space, lower-cased, without punctuation."""
    out = list(map(known.__getitem__, text.lower().split()))
    return [v for v in out if v] if 0 in out else out


def token_runs(texts: list[str], known: WordHashes):
    """(first, tokens, ends): the tokens of successive texts from number `first` on, laid end to end, and where each ends.

    A run closes with the text that fills RUN_TOKENS, so that numpy's steps cost little for a text and stay in the cache.
    """
    import numpy as np

    first, tokens, ends = 0, [], []
    for i, text in enumerate(texts):
        tokens += token_hashes(text, known)
        ends.append(len(tokens))
        if len(tokens) >= RUN_TOKENS or i == len(texts) - 1:
            yield first, np.array(tokens, np.uint64), np.array(ends)
            first, tokens, ends = i + 1, [], []


def seed_hashes(tokens, mask: str):
    """The hash of the masked tokens from each position on, as uint64: a polynomial of token hashes, mixed."""
    import numpy as np

    n = max(len(tokens) - len(mask) + 1, 0)
    out = np.full(n, len(mask) * 2 + mask.count("1"), np.uint64)
    if n:
        factor = np.uint64(0xC2B2AE3D27D4EB4F)
        for i, c in enumerate(mask):
            if c == "1":
                out *= factor
                out += tokens[i:i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def masks_for(n: int) -> list[str]:
    """The masks that seed an item, or a window, of n tokens."""
    longest = max(map(len, MASKS))
    whole = ["1" * n] if LEAST <= n < longest else []
    return [*[m for m in MASKS if len(m) <= n], *SHORT_MASKS.get(n, ()), *whole]


def masks_of(lengths: list[int]) -> list[str]:
    """The fixed masks, those that items of these lengths need besides, and whole ones for the shortest items."""
    own = [m for n in sorted(set(lengths)) for m in masks_for(n) if m not in MASKS]
    return [*MASKS, *dict.fromkeys(sorted(own, key=lambda m: "0" not in m and len(m) in lengths))]


def _item_tokens(batches):
    import numpy as np
    import pyarrow as pa

    known = WordHashes()
    for batch in slices(batches):
        tokens = [np.array(token_hashes(t, known), np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))],
                                         names=["item", "tokens"])


def _item_seeds(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.array(tokens, np.int64).view(np.uint64)
                for mask in masks_for(min(window, len(tokens))):
                    seeds = seed_hashes(tokens, mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), item)),
                         pa.array(np.arange(len(seeds)))], names=["seed", "item", "at"])

    return run


def _regions(masks: list[str], words, bits: int, reach: int):
    def run(batches):
        """Stretches of documents around seeds that the benchmark may have, with their tokens and these seeds."""
        import numpy as np
        import pyarrow as pa

        table, known = words.value, WordHashes()
        top, second, low = np.uint64(64 - bits), np.uint64(64 - 2 * bits), np.uint64((1 << bits) - 1)
        seven, six = np.uint64(63), np.uint64(6)
        seed_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())]))

        def may_have(seeds):
            a, b = seeds >> top, (seeds >> second) & low
            hit = np.flatnonzero((table[a >> six] >> (a & seven)) & np.uint64(1))
            b = b[hit]
            return hit[np.flatnonzero((table[b >> six] >> (b & seven)) & np.uint64(1))]

        for batch in slices(batches):
            out = []
            for first, tokens, ends in token_runs(batch.column(2).to_pylist(), known):
                found = []
                for mask in masks:
                    seeds = seed_hashes(tokens, mask)
                    hits = may_have(seeds)
                    texts = np.searchsorted(ends, hits, "right")
                    within = hits + len(mask) <= ends[texts]  # a seed does not reach into the next text
                    hits, texts = hits[within], texts[within]
                    found += zip(texts.tolist(), hits.tolist(), seeds[hits].view(np.int64).tolist())
                found.sort()
                at = 0
                while at < len(found):
                    end, text = at + 1, found[at][0]
                    while end < len(found) and found[end][0] == text and found[end][1] - found[end - 1][1] <= 2 * reach:
                        end += 1
                    begins = int(ends[text - 1]) if text else 0
                    begin = max(begins, found[at][1] - reach)
                    stop = min(int(ends[text]), found[end - 1][1] + 2 * reach)
                    out.append((first + text, begin - begins, tokens[begin:stop].view(np.int64),
                                [{"seed": s, "at": p - begin} for _, p, s in found[at:end]]))
                    at = end
            if out:
                rows = pa.array([r[0] for r in out])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], seed_type)],
                    names=["id", "hash", "begin", "tokens", "seeds"])

    return run


def _verify(window: int, similarity: float):
    def run(batches):
        """The best share of equal tokens in a window of an item laid over a region at one offset."""
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            best = []
            for row in batch.to_pylist():
                doc, item, shift = row["tokens"], row["item_tokens"], row["shift"]
                size = min(window, len(item))
                low, high = max(0, -shift), min(len(item), len(doc) - shift)
                if high - low < size:
                    best.append(0.0)
                    continue
                same = np.equal(doc[low + shift:high + shift], item[low:high]).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(same)])
                best.append(float((sums[size:] - sums[:-size]).max()) / size)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "hash", "item", "item_id")], pa.array(best, pa.float64())],
                names=["id", "hash", "item", "item_id", "overlap"])

    return run


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, window: int = 20,
                           filter_bits: int = 26, id_col: str = "doc_id", text_col: str = "text",
                           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document: doc_id, contaminated (true), n_items, item_ids (sorted), overlap, hash.

    A document is contaminated by an item if, laid over each other at some offset, a window of `window` tokens of the
    item (all of it if it is shorter) agrees in `similarity` of its tokens or more, position by position: tokens may
    be substituted, not inserted. All such windows of up to 20 tokens are found at a similarity of 0.8 or more; with
    other values the masks may pass some by. Tokens are the words between white space, lower-cased, without punctuation.

    Spaced-seed hashing: fixed masks ignore chosen token positions, and the masked hashes of both sides are joined. A
    filter of 2^filter_bits bits over the benchmark's hashes, of that size whatever the benchmark holds, goes to the
    tasks, so that of the documents only seeds that may occur there (two bits are looked up) and the tokens around them
    are shuffled; a full filter would cost time, not results. Seeds meet by their hash in a join of written
    tables, which adaptive execution splits where a passage is in very many documents; each pair of region and item is
    then verified once per offset. Items with the same tokens are one item (the smallest id); an item whose id is
    null is looked for like any other and stands as a null at the end of item_ids, once for each such text.

    Null texts and texts without words hold nothing; items of under five tokens are not looked for. Null ids and
    repeated ids are told apart by the hash of the text; rows that agree in both give one row. Empty tables give no
    rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"),
                             F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    items = items.mapInArrow(_item_tokens, "item long, tokens array<long>").where(
        F.size("tokens") >= LEAST).groupBy("tokens").agg(F.min("item").alias("item_id")).select(
        F.xxhash64("tokens").alias("item"), "item_id", "tokens")
    items = materialise(items, "items")
    lengths = [r[0] for r in items.where(F.size("tokens") < WINDOW).select(
        F.size("tokens")).distinct().collect()]  # a handful of small numbers
    masks = masks_of([min(window, n) for n in [*lengths, WINDOW]])
    seeds = materialise(items.select("item", "tokens").mapInArrow(_item_seeds(window), "seed long, item long, at long"), "item-seeds")
    bit = lambda shift: F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(2 ** filter_bits - 1))
    lit_bits = seeds.select(F.explode(F.array(bit(64 - filter_bits), bit(64 - 2 * filter_bits))).alias("bit"))
    filled = lit_bits.select(F.shiftright("bit", 6).alias("word"), F.expr(
        "shiftleft(1L, cast(bit & 63 as int))").alias("value")).groupBy("word").agg(F.expr("bit_or(value)").alias("value"))
    words = spark.sparkContext.broadcast(_filter_words(filled, filter_bits))

    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    reach = window + max(map(len, masks))
    regions = rows.mapInArrow(
        _regions(masks, words, filter_bits, reach),
        "id long, hash long, begin long, tokens array<long>, seeds array<struct<seed:long,at:long>>").withColumn(
        "region", F.xxhash64("id", "hash", "begin"))
    regions = materialise(regions, "regions")
    hits = regions.select("region", "id", "hash", F.inline("seeds")).withColumnRenamed("at", "doc_at")
    pairs = hits.join(seeds, "seed").select(
        "region", "id", "hash", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    pairs = materialise(pairs, "pairs")
    laid = pairs.join(regions.select("region", "id", "hash", "tokens"), ["region", "id", "hash"]).join(
        items.withColumnRenamed("tokens", "item_tokens"), "item")
    found = laid.select("id", "hash", "item", "item_id", "shift", "tokens", "item_tokens").mapInArrow(
        _verify(window, similarity), "id long, hash long, item long, item_id long, overlap double").where(
        F.col("overlap") >= similarity)
    return found.groupBy("id", "hash").agg(
        F.array_sort(F.transform(F.collect_set(F.struct("item_id", F.expr("if(item_id is null, item, 0)"))),
                                 lambda x: x["item_id"])).alias("item_ids"), F.max("overlap").alias("overlap")).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.lit(True).alias("contaminated"),
        F.size("item_ids").cast("long").alias("n_items"), "item_ids", "overlap", "hash")


def _filter_words(filled: DataFrame, bits: int):
    """The filter as an array of 2^bits / 64 words; so many rows reach the driver at most."""
    import numpy as np

    rows = filled.toPandas()
    words = np.zeros(2 ** bits // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64)
    return words.view(np.uint64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates."""
    found = contaminated_documents(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__bad_id"), F.col("hash").alias("__bad_hash"))
    found = materialise(found, "contaminated")
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == found["__bad_id"]) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["__bad_hash"])
    return docs.join(found, same, "left_anti")
