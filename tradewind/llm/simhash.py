"""Near duplicates by SimHash fingerprints that differ in few bits, compared bit-sliced."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import NO_ID, id_and_text, packed_rows, slices

BITS = 64
POOL = 1024  # fingerprints compared with each other at once
BLOCK = 4096  # fingerprints of a bucket in one task's group


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all `width`-word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: lower() and split() look at ASCII only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    n = len(starts)
    hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())),
                         np.uint64, n)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, the hash of the text and the fingerprint as a signed long; no shuffle."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    ids = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            prints = np.array([fingerprint(t, width, seed) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "hash", "fp"])

    return rows.mapInArrow(run, f"doc_id {ids}, hash long, fp long")


def bit_sliced_links(left, right, radius: int, same: bool):
    """Index pairs (i, j) of two arrays of uint64 whose values differ in at most `radius` bits; i < j if `same`.

    The values of `right` are stored as bit planes, one bit of 64 values in a word. A lane is a value of `left`
    against a word of planes. Differences are added into bitwise counters by carries, as many as the radius has bits
    and three at least; they start at the largest count they hold less the radius, so the bit that leaves them says that
    the radius is exceeded. After every eighth plane the lanes in which all 64 pairs are over the radius are abandoned.
    """
    import numpy as np

    words = -(-len(right) // 64)
    bits = np.zeros((BITS, words * 64), np.uint8)
    shifts = np.arange(BITS, dtype=np.uint64)[:, None]
    bits[:, :len(right)] = ((right[None, :] >> shifts) & np.uint64(1)).astype(np.uint8)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)  # BITS x words
    masks = (np.uint64(0) - ((left[None, :] >> shifts) & np.uint64(1)))  # all ones where the bit is set
    valid = np.zeros((1, words * 64), np.uint8)
    valid[0, :len(right)] = 1
    ends = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64)[0]
    probe, word = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(words), indexing="ij"))
    if same:
        keep = (word + 1) * 64 > probe + 1
        probe, word = probe[keep], word[keep]
    over = ends[word]
    levels = max(3, radius.bit_length())
    start = 2 ** levels - 1 - radius
    counters = [np.full(len(word), -(start >> k & 1) & (2 ** 64 - 1), np.uint64) for k in range(levels)]
    full = np.uint64(2 ** 64 - 1)
    for k in range(BITS):
        carry = planes[k][word] ^ masks[k][probe]
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if k % 8 == 7:
            alive = np.flatnonzero(over != full)
            if len(alive) < 0.7 * len(over):
                probe, word, over = probe[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
    alive = np.flatnonzero(over != full)
    lanes, at = np.nonzero(np.unpackbits((~over[alive]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    i, j = probe[alive][lanes], word[alive][lanes] * 64 + at
    return (i[i < j], j[i < j]) if same else (i, j)


def forest(n: int, i, j):
    """For each of n nodes the smallest node it reaches over the undirected links (i, j)."""
    import numpy as np

    labels = np.arange(n)
    while len(i):
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        open_ = labels[i] != labels[j]
        i, j = i[open_], j[open_]
        if len(i):  # roots hook on, too
            a, b = labels[i], labels[j]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
    while (labels != labels[labels]).any():
        labels = labels[labels]
    return labels


def _groups(batches):
    """Rows sorted by (tab, key, lo, hi): for each group its lo, hi, and per row the block and the value."""
    import numpy as np

    rest = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])) + 1
        bounds = [0, *new.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield cols[2][a], cols[3][a], cols[4][a:b], cols[5][a:b].view(np.uint64)
        rest = [c[bounds[-1]:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest[2][0], rest[3][0], rest[4], rest[5].view(np.uint64)


def _bucket_links(radius: int):
    """Links within sorted groups, as the edges of one spanning forest for each pair of pools."""
    def pairs(left, right=None):
        import numpy as np

        tiles = lambda v: [v[a:a + POOL] for a in range(0, len(v), POOL)]
        if right is None:
            parts = tiles(left)
            todo = [(x, y, a == b) for a, x in enumerate(parts) for b, y in enumerate(parts) if a <= b]
        else:
            todo = [(x, y, False) for x in tiles(left) for y in tiles(right)]
        for x, y, same in todo:
            i, j = bit_sliced_links(x, y, radius, same)
            if len(i):
                both, j = (x, j) if same else (np.concatenate([x, y]), j + len(x))
                root = forest(len(both), i, j)
                child = np.flatnonzero(both != both[root])
                yield both[child].view(np.int64), both[root[child]].view(np.int64)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(found):
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        pool, pooled = [], 0
        for lo, hi, own, values in _groups(batches):
            if lo != hi:
                yield from edges(pairs(values[own == lo], values[own == hi]))
            elif len(values) > POOL:
                yield from edges(pairs(values))
            elif len(values) > 1:  # small groups share a pool: a link across two of them is a link all the same
                if pooled + len(values) > POOL:
                    yield from edges(pairs(np.unique(np.concatenate(pool))))
                    pool, pooled = [], 0
                pool.append(values)
                pooled += len(values)
        if pool:
            yield from edges(pairs(np.unique(np.concatenate(pool))))

    return run


def key_layout(n: int, radius: int, load: int = 256) -> tuple[list[int], int]:
    """Widths of the blocks that 64 bits are cut into, and how many of them make a key.

    With radius + k blocks, two values within the radius agree on k blocks at least, whichever those are; all
    choices of k blocks are looked up. k is the smallest with at most `load` values a bucket on average, so a
    value is compared with a bounded number of strangers at every size.
    """
    k = 1
    while True:
        blocks = radius + k
        widths = [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]
        if k == 4 or n <= load * 2 ** sum(sorted(widths)[:k]):
            return widths, k
        k += 1


def fingerprint_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within the radius of each other.

    Every pair within the radius is compared, in a bucket of a key on which both agree; only the edges of a
    spanning forest leave a pool, not all its pairs. A bucket of more than BLOCK values is cut into blocks
    by hash, and each pair of blocks is a group of its own, so no task holds a large bucket.
    """
    n = prints.count()
    widths, k = key_layout(n, radius)
    starts = [sum(widths[:i]) for i in range(len(widths))]
    fp = F.col("fp")
    keys = []
    for chosen in combinations(range(len(widths)), k):
        key = F.lit(0).cast("long")
        for i in chosen:
            part = F.shiftrightunsigned(fp, starts[i]).bitwiseAND(F.lit(2 ** widths[i] - 1))
            key = F.shiftleft(key, widths[i]).bitwiseOR(part)
        keys.append(key)
    rows = materialise(prints.select(fp, F.posexplode(F.array(*keys)).alias("tab", "key")), "simhash-keys")
    large = rows.groupBy("tab", "key").count().where(F.col("count") > 1).select(
        "tab", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # a key of one value has nothing to compare and leaves here
    dealt = rows.join(materialise(large, "simhash-buckets"), ["tab", "key"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["tab", "key", "lo", "hi"]
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                         "own", "fp")
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_bucket_links(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label of every node of the undirected edges (a, b); nodes share a label if a path joins them.

    Each round hooks every node to its smallest neighbour, shortens the chains that arise and contracts the
    edges; rounds grow with the logarithm of the longest path. Every round's tables are written to the shared
    folder, and only row counts reach the driver. An aggregation of minima precedes each shuffle of a hub, and
    joins read written tables, so that adaptive execution can split a hub's rows.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("to"))
        hooks = materialise(hooks, "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hooks = materialise(hooks.join(onward, "to", "left").select(
                "node", F.coalesce("further", "to").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("label"))
        else:
            step = hooks.select(F.col("node").alias("label"), "to")
            labels = materialise(labels.join(step, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(end), "to"), end, "left").withColumn(
                end, F.coalesce("to", end)).drop("to")
        edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
            F.col("a") != F.col("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def simhash_dedup(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, hash.

    component_id is the smallest id that links of fingerprints within `radius` bits reach, itself included.
    Texts are lower-cased (A-Z) and cut at ASCII white space; a bit of the fingerprint is set if it is set in
    over half of the XXH64 values of the `width`-word shingles. Documents with equal fingerprints become one
    node before any comparison, so exact copies cost an aggregation and no pairs. One document of each component is
    kept: that of the smallest id, of several texts with that id the one with the smallest hash.

    Null texts count as empty; a text without words has fingerprint 0, which links like any other. Null ids count
    as the smallest. Rows that repeat an id are rows of their own; rows that agree in id and text are kept or dropped
    together. An empty table gives no rows. Columns other than id and text are not looked at.
    """
    rows = materialise(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "hash")).alias("low")), "nodes")
    labels = components(fingerprint_links(nodes.select("fp"), radius))
    nodes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    nodes = materialise(nodes, "labelled")
    lowest = materialise(nodes.groupBy("label").agg(F.min("low").alias("lowest")), "lowest")
    ids = materialise(nodes.join(lowest, "label").select("fp", "lowest"), "ids")
    return rows.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lowest.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("hash") == F.col("lowest.hash"))).alias("kept"),
        "hash")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns: one row of each component of near duplicates."""
    kept = simhash_dedup(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    kept = materialise(kept.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kept_id"),
                                   F.col("hash").alias("kept_hash")).distinct(), "kept")
    keyed = packed_rows(docs, id=F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
                        hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # most documents are kept, so this side grows with the documents and is merged at every size
    joined = keyed.join(kept.hint("merge"), (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    return joined.withColumn("place", first).where("place = 1").select("row.*")
