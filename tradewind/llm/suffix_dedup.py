"""Removal of byte strings that occur elsewhere in the corpus: names at anchors, sorted, then names of growing length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import NO_ID, id_and_text

SEED = 16  # bytes that decide which position of a window is its anchor
CHUNK = 1 << 22  # bytes looked at at once
HELD = 20_000  # rows of one first rank that a task keeps in memory
BLOCK = 256  # open stretches of one core whose strings are named in one task's group; more are cut to longer cores first
FULL, OPEN, EDGE = 1, 2, 4


def window_of(length: int) -> int:
    """Positions that share a choice of anchor: the largest power of two that leaves a core of a third."""
    if length < SEED + 8:
        raise ValueError(f"the length must be {SEED + 8} at least")
    window = 1
    while 2 * window <= min(length * 2 // 3, length - SEED + 1):
        window *= 2
    return window


def stretches(data, starts, sizes, length: int):
    """First and last position and the anchor of each stretch of neighbouring positions with one anchor.

    A position is one at which a string of `length` bytes starts inside its document; its anchor is the leftmost
    smallest hash of SEED bytes among the `window` positions from it on. That choice depends on the bytes of the
    string alone, so equal strings have their anchors at equal distances.
    """
    import numpy as np

    window, n = window_of(length), int(sizes.sum())
    word = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))[:n + window + SEED - 8]
    mixed = word * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    value = mixed[:n + window] + mixed[SEED - 8:][:n + window] * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xC2B2AE3D27D4EB4F)
    low = np.uint64((1 << 24) - 1)
    value &= ~low
    value |= np.arange(len(value), dtype=np.uint64)
    span = 1
    while span < window:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    anchor = (value & low).astype(np.int64)[:n]
    change = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(change, starts[long], 1)
    np.add.at(change, (starts + sizes)[long] - length + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    turn = np.ones(n, bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    turn[starts[(starts < n) & (sizes > 0)]] = True
    first = np.flatnonzero(inside & turn)
    ends = np.ones(n, bool)
    ends[:-1] = turn[1:] | ~inside[1:]
    return first, np.flatnonzero(inside & ends), anchor[first]


def _names(data, begins, ends):
    """128-bit names of byte strings as two arrays of signed longs."""
    import numpy as np
    import xxhash

    view = memoryview(data)
    digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist())])
    pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _chunks(batch, length: int):
    """(row numbers, starts within the documents, starts within the data, sizes, data), a bounded number of bytes each."""
    import numpy as np

    texts = batch.column(2)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        a, b = offsets[row], offsets[end]
        if b - a <= 2 * CHUNK:
            parts = [(np.arange(row, end), np.zeros(end - row, np.int64), a, offsets[row:end] - a,
                      np.diff(offsets[row:end + 1]), b)]
        else:  # one very long text: parts that overlap by less than a string
            parts = [(np.array([row]), np.array([at - a]), at, np.zeros(1, np.int64),
                      np.array([min(b, at + CHUNK + length - 1) - at]), min(b, at + CHUNK + length - 1))
                     for at in range(a, max(a + 1, b - length + 1), CHUNK)]
        for rows, within, at, starts, sizes, stop in parts:
            data = np.zeros(stop - at + length + SEED + 8, np.uint8)
            data[:stop - at] = content[at:stop]
            yield rows, within, starts, sizes, data
        row = end


def _ranks(length: int):
    def run(batches):
        """For each stretch the name of its core, common to all its strings, and the name of all its bytes."""
        import numpy as np
        import pyarrow as pa
        import xxhash

        core = length - window_of(length) + 1
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for rows, within, starts, sizes, data in _chunks(batch, length):
                if not sizes.sum():
                    continue
                first, last, anchor = stretches(data, starts, sizes, length)
                if not len(first):
                    continue
                of = np.searchsorted(starts, first, "right") - 1
                view = memoryview(data)
                cores = np.array([xxhash.xxh64_intdigest(view[a:a + core]) for a in anchor.tolist()], np.uint64)
                high, low = _names(data, first, last + length)
                shift = within[of] - starts[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (cores.view(np.int64), high, low, keys[0][rows[of]], keys[1][rows[of]],
                                           first + shift, last + shift)],
                    names=["core", "high", "low", "id", "hash", "first", "last"])

    return run


def _rerank(batches):
    """Compare sorted neighbours: what is alone leaves, what has an equal stretch is settled, the rest stays open.

    The first and the last core of a partition may go on in another one, and a core of very many rows is judged in
    parts; of these, one row of each stretch name also leaves as EDGE, to be counted across parts by an aggregation.
    """
    import numpy as np
    import pyarrow as pa

    names = ["kind", "core", "high", "low", "id", "hash", "first", "last"]

    def out(kind, cols):
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), *map(pa.array, cols)], names=names)

    def judged(cols, edges):
        core, high, low = cols[:3]
        if not len(core):
            return
        new_core = np.concatenate([[True], core[1:] != core[:-1]])
        new_name = new_core.copy()
        new_name[1:] |= (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        by_core, by_name = np.cumsum(new_core) - 1, np.cumsum(new_name) - 1
        kind = np.where(np.bincount(by_name)[by_name] > 1, FULL, 0)
        several = np.bincount(by_core[new_name])[by_core] > 1
        kind |= np.where(new_name, np.where(np.isin(core, edges), EDGE, np.where(several, OPEN, 0)), 0)
        keep = kind > 0
        if keep.any():
            yield out(kind[keep], [c[keep] for c in cols])

    rest, begin, large = None, None, []
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        begin = cols[0][0] if begin is None else begin
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        before = np.flatnonzero(cols[0] != cols[0][-1])
        cut = before[-1] + 1 if len(before) else 0
        yield from judged([c[:cut] for c in cols], [begin, *large])
        rest = [c[cut:] for c in cols]
        if len(rest[0]) > HELD:
            large = [rest[0][0]]
            yield from judged(rest, large)
            rest = None
    if rest is not None:
        yield from judged(rest, [rest[0][-1]] if len(rest[0]) else [])


def _pack(batches):
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            packed = [packer.compress(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())],
                                             names=["id", "hash", "packed"])


def _cut_out(length: int):
    def run(batches):
        """The bytes of the open stretches of each document."""
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(start, 256).to_pylist():
                    text = unpacker.decompress(row["packed"])
                    out += [(s["core"], row["id"], row["hash"], s["first"], text[s["first"]:s["last"] + length])
                            for s in row["open"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])],
                    names=["core", "id", "hash", "first", "bytes"])

    return run


def _halve(length: int):
    """Cut the positions of each stretch, by their distance from the anchor, into two halves with longer cores.

    The strings at the distances `near` to `far` have the bytes between their last start and their first end in common.
    Equal strings have equal distances, so they meet in the same half under the same core.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()]
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.slice(start, 4096).to_pylist()
                sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
                starts = np.cumsum(sizes) - sizes
                data = np.zeros(int(sizes.sum()) + length + SEED + 8, np.uint8)
                data[:int(sizes.sum())] = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
                first, last, anchor = stretches(data, starts, sizes, length)
                out = []
                for r, lead, n in zip(rows, (anchor - first).tolist(), (last - first + 1).tolist()):
                    middle, text = (r["near"] + r["far"]) // 2, r["bytes"]
                    for near, far in ((r["near"], middle), (middle + 1, r["far"])):
                        a, b = max(0, lead - far), min(n - 1, lead - near)
                        if near > far or a > b:
                            continue
                        core = xxhash.xxh64_intdigest(text[lead - near:lead - far + length], seed=far - near)
                        name = xxhash.xxh3_128_digest(text[a:b + length])
                        out.append((core - (core >> 63 << 64), int.from_bytes(name[:8], "little", signed=True),
                                    int.from_bytes(name[8:], "little", signed=True), near, far, r["id"], r["hash"],
                                    r["first"] + a, text[a:b + length]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[
                    "core", "high", "low", "near", "far", "id", "hash", "first", "bytes"])

    return run


def _settle(length: int):
    """Name every string of the stretches of a core; equal names settle their positions."""
    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import xxhash

        def settled(rows):
            names = [[xxhash.xxh3_128_digest(r["bytes"][i:i + length]) for i in range(len(r["bytes"]) - length + 1)]
                     for r in rows]
            counts, out = Counter(n for own in names for n in own), []
            for r, own in zip(rows, names):
                again = np.array([counts[n] > 1 for n in own])
                turns = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                out += [(r["id"], r["hash"], r["first"] + int(a), r["first"] + int(b) - 1 + length)
                        for a, b in zip(turns[::2], turns[1::2])]
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                              names=["id", "hash", "begin", "stop"])

        rows, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["core"] != rows[0]["core"]:
                    out += settled(rows)
                    rows = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        if rows:
            out += settled(rows)
        if out:
            yield batch_of(out)

    return run


def _remove(batches):
    """Merge the covered spans of each document and hash what is left."""
    import hashlib

    import pyarrow as pa
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(start, 256).to_pylist():
                text, merged = unpacker.decompress(row["packed"]), []
                for span in sorted((s["begin"], s["stop"]) for s in row["spans"] or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((None if row["id"] == NO_ID else row["id"], row["hash"], len(text),
                            sum(b - a for a, b in merged), len(merged), kept.hexdigest(),
                            [{"begin": a, "stop": b} for a, b in merged]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[
                "doc_id", "hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, stop in bytes).

    Every byte is removed that a string of `length` bytes covers which also starts anywhere else, in another
    document or the same one; overlaps count. Nothing is dropped, capped or estimated: the result is that of a full
    suffix array cut at `length`, up to collisions of 128-bit names.

    Names at anchors stand in for the ranks of a suffix array. Doubling over all positions would sort a rank pair for
    every byte in every round; here anchors are positions chosen by their own bytes such that any two equal strings have
    them at equal distances (one in about 90). A name is a hash, equal for equal bytes.
      1. Spark sorts pairs of names by range: that of the bytes that all strings with the anchor share, the core (about a
         third of `length`), then that of the whole stretch (`length` bytes and more). Neighbours are compared: a core
         that occurs once leaves, a pair that occurs again is past the threshold and settles its whole stretch.
      2. Stretches with an equal core and different whole names stay open, one for each pair, and their bytes are cut
         out. While a core has more than BLOCK of them, their positions are halved by the distance from the anchor, each
         half is named anew by its longer core and its whole bytes, and equal pairs settle, unique cores leave and the
         others stay open as before; single positions are reached in log2(window) rounds. A round makes at most two rows
         of an open stretch, so rows stay in proportion to stretches however many share a core.
      3. Cores of at most BLOCK open stretches come to one task each, where every string gets its own name.
      4. The settled spans of a document are merged, and the rest is hashed.
    Sampled splitters cut a rank that very many rows share over several partitions; the rows at the borders are
    counted by an aggregation that combines before it shuffles. Texts travel compressed.

    Texts are their UTF-8 bytes; null counts as empty. Ids are integers; null ids and repeated ids are told apart
    by the hash of the text, and rows that agree in both have equal results (each is "elsewhere" for the
    other). An empty table gives no rows. Columns other than id and text are not looked at.
    """
    window_of(length)  # refuses lengths that are too short
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"),
        F.col("text").cast("binary").alias("bytes"))
    pair, key = ["core", "high", "low"], ["id", "hash"]
    columns = "core long, high long, low long, id long, hash long, first long, last long"
    ranks = rows.where(F.octet_length("bytes") >= length).mapInArrow(_ranks(length), columns)
    order = [*pair, *key, "first"]
    ranked = materialise(ranks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _rerank, "kind byte, " + columns), "ranks")

    flag = lambda bit: F.col("kind").bitwiseAND(bit) != 0
    edge = ranked.where(flag(EDGE))
    classes = materialise(edge.groupBy(*pair).agg(F.sum(F.when(flag(FULL), 2).otherwise(1)).alias("n"),
                                                  F.min(F.struct(*key, "first")).alias("low_row")), "edge-classes")
    cores = materialise(classes.groupBy("core").agg(F.count("*").alias("classes")), "edge-cores")
    edge = edge.join(classes, pair).join(cores, "core").select(
        *pair, *key, "first", "last", (F.col("n") > 1).alias("full"),
        ((F.col("classes") > 1) & (F.struct(*key, "first") == F.col("low_row"))).alias("open"))
    judged = ranked.where(~flag(EDGE)).select(
        *pair, *key, "first", "last", flag(FULL).alias("full"), flag(OPEN).alias("open")).unionByName(edge)

    packed = rows.mapInArrow(_pack, "id long, hash long, packed binary")
    opened = judged.where("open").groupBy(*key).agg(F.collect_list(F.struct("core", "first", "last")).alias("open"))
    cut = packed.join(opened, key).select(*key, "packed", "open").mapInArrow(
        _cut_out(length), "core long, id long, hash long, first long, bytes binary")
    window = window_of(length)
    cut = materialise(cut.withColumns({"near": F.lit(0), "far": F.lit(window - 1)}), "open-stretches")
    spans = judged.where("full").select(*key, F.col("first").alias("begin"), (F.col("last") + length).alias("stop"))
    for left in reversed(range(window.bit_length())):
        sizes = materialise(cut.groupBy("core").agg(F.count("*").alias("rows")), "open-cores")
        many = F.col("rows") > BLOCK if left else F.lit(False)
        dealt = cut.join(sizes, "core")
        small = dealt.where(~many).repartition("core").sortWithinPartitions("core")
        spans = spans.unionByName(materialise(small.mapInArrow(
            _settle(length), "id long, hash long, begin long, stop long"), "settled"))
        if sizes.where(many).isEmpty():
            break
        halves = materialise(dealt.where(many).mapInArrow(_halve(length), "core long, high long, low long, near int, "
                             "far int, id long, hash long, first long, bytes binary"), "longer-cores")
        classes = materialise(halves.groupBy(*pair).agg(
            F.count("*").alias("n"), F.min(F.struct(*key, "first")).alias("low_row")), "longer-classes")
        cores = materialise(classes.groupBy("core").agg(F.count("*").alias("classes")), "longer-cores-of")
        halves = halves.join(classes, pair)
        spans = spans.unionByName(halves.where("n > 1").select(
            *key, F.col("first").alias("begin"), (F.col("first") + F.length("bytes")).cast("long").alias("stop")))
        cut = materialise(halves.where(F.struct(*key, "first") == F.col("low_row")).join(
            cores.where("classes > 1"), "core").select(*cut.columns), "open-stretches")
    spans = spans.groupBy(*key).agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    return packed.join(spans, key, "left").select(*key, "packed", "spans").mapInArrow(
        _remove, "doc_id long, hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                 "spans array<struct<begin:long,stop:long>>").drop("hash")
