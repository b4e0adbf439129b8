"""How the tokens of two tokenizers line up, and how often each pair of ids does so across the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import id_and_text, slices, vocabulary_path, worker_cache
from .perfect_hash import PerfectHash

BLOCK_CHARS, BLOCK_DOCS, BLOCK_CHUNKS = 8 << 20, 16_384, 500_000  # a block of texts ends at any of these
KEPT_CHUNKS = 200_000  # chunks that a worker still remembers when a block begins
BUCKET = 16_384  # pairs of one perfect hash function on average
LANE = 16  # rows summed into one dense vector, as a multiple of its length
FAN = 16  # vectors added at once in the tree
SHIFT = 32


def byte_pair_encoder(path: str):
    """A function from texts to ids by a byte-level vocabulary file, special strings as plain text, and whether the
    tokens of a text are its own bytes, so that none is changed if none is lost.

    Where the ids of a plain byte-level vocabulary are in the order of its merges, merging by rank is merging by id,
    which `tiktoken` does in half the time; else the file's own library encodes.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from .token_counts import PIECES, byte_letters

    spec = json.load(open(path, encoding="utf-8"))
    vocabulary, byte_of = spec["model"]["vocab"], {letter: byte for byte, letter in enumerate(byte_letters())}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    plain = spec.get("normalizer") is None and spec.get("pre_tokenizer", {}).get("type") == "ByteLevel" and spec[
        "pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space") and [
        vocabulary.get(m) for m in merges] == list(range(256, 256 + len(merges)))
    if plain:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, True
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, False


class Aligner:
    """Aligns words of texts by the byte ends of both token sequences, and remembers them by number.

    Both tokenizers work on each part between single spaces by itself: the byte-level one starts a new piece there, and no
    piece of the other goes on over a space. Where a vocabulary breaks this, texts stay whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import json
        import os
        import re

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        from .token_counts import byte_letters

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = Tokenizer.from_file(path_a)
        self.encode_a, self.exact_a = byte_pair_encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.bytes_a = [b""] * vocabulary.get_vocab_size()
        for token, i in vocabulary.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        spec = json.load(open(path_a, encoding="utf-8"))
        split = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not any(
            re.search("[^▁]▁", p) for p in pieces)
        self.joints = re.compile(r" (?<=\S )(?=\S)" if split else r"(?!)")
        # whether chunks may be encoded one after the other in one call
        self.joined = (lambda c: c and c.strip() == c) if split else (lambda c: False)
        self.np = np
        self.sizes_a, self.sizes_b = (np.array(list(map(len, own)), np.int64) for own in (self.bytes_a, self.bytes_b))
        number = [b"%d" % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # the id and what follows it: another id of the group, the other side, the next group, the end of the chunk
        self.shown = np.array([n + mark for mark in (b",", b"|", b";", b"") for n in number], object)
        self.shown_sizes, self.marks = np.array(list(map(len, self.shown)), np.int64), len(number)
        self.pieces_a, self.pieces_b = (np.array(own, object) for own in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        from array import array

        # chunk 0 is none, so that no array is empty
        self.texts: list[bytes] = [b""]  # the groups of a chunk as text
        self.number: dict[str, int] = {}
        self.sizes = array("q", [0] * 5)  # tokens of a, of b, groups, links, and 1 if its bytes are not kept
        self.pairs, self.times, self.ends, self.lost = array("q", [0]), array("q", [0]), array("q", [1, 1]), False

    def learn(self, new: list[str]) -> None:
        """Give new chunks the next numbers and align them in that order."""
        first = len(self.texts)
        self.number.update(zip(new, range(first, first + len(new))))
        apart = [i for i, chunk in enumerate(new) if not self.joined(chunk)]
        start = 0
        for stop in [*apart, len(new)]:
            for at in range(start, stop, 500):
                self.add_together(new[at:min(at + 500, stop)])
            if stop < len(new):
                self.add(" " + new[stop], self.encode_a(" " + new[stop]), self.b.encode(new[stop]))
            start = stop + 1

    def add_together(self, chunks: list[str]) -> None:
        """Align many chunks as one text, or each by itself where some chunk's bytes are not kept."""
        if chunks and not self.add_all(chunks):
            for chunk in chunks:
                self.add(" " + chunk, self.encode_a(" " + chunk), self.b.encode(chunk))

    def add_all(self, chunks: list[str]) -> bool:
        """Align many chunks as one text. A group ends where both sides end, as every chunk does."""
        np = self.np
        text = " ".join(chunks)
        raw = (" " + text).encode()
        ids_a, ids_b = self.encode_a(" " + text), self.b.encode(text)
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        if not len(a) or not len(b) or ends_a[-1] != len(raw) or ends_b[-1] != len(raw):
            return False
        if not (self.exact_a or b"".join(self.pieces_a[a].tolist()) == raw) or b"".join(self.pieces_b[b].tolist()) != raw:
            return False
        at_end = np.zeros(len(raw) + 1, bool)
        at_end[ends_a] = True
        last_b = np.flatnonzero(at_end[ends_b])  # last tokens of the groups
        common = ends_b[last_b]
        last_a = np.searchsorted(ends_a, common)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        if int((n_a * n_b).sum()) > 64 * (len(a) + len(b)):
            return False
        chunk_ends = np.cumsum(list(map(len, map(str.encode, chunks)))) + np.arange(1, len(chunks) + 1)
        last_group = np.searchsorted(common, chunk_ends)
        group_a, group_b = np.repeat(np.arange(len(common)), n_a), np.repeat(np.arange(len(common)), n_b)
        # every pair of tokens of a group
        times_a = n_b[group_a]
        first = np.cumsum(times_a) - times_a
        at_b = np.repeat((last_b - n_b + 1)[group_a] - first, times_a) + np.arange(int(times_a.sum()))
        pairs = np.repeat(a, times_a) << SHIFT | b[at_b]
        # the groups as text, sides one after the other
        closing = np.full(len(common), 2)
        closing[last_group] = 3
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, closing
        place_a = np.arange(len(a)) + (last_b - n_b + 1)[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        shown, sizes = np.empty(len(a) + len(b), object), np.zeros(len(a) + len(b), np.int64)
        for ids, marks, place in ((a, mark_a, place_a), (b, mark_b, place_b)):
            own = marks * self.marks + ids
            shown[place] = self.shown[own]
            sizes[place] = self.shown_sizes[own]
        whole = b"".join(shown.tolist())
        text_ends = np.cumsum(sizes)[place_b[last_b[last_group]]].tolist()
        self.texts += [whole[x:y] for x, y in zip([0, *text_ends], text_ends)]
        per = lambda totals: np.diff(totals, prepend=0)
        links = np.cumsum(n_a * n_b)[last_group]
        table = np.stack([per(last_a[last_group] + 1), per(last_b[last_group] + 1), per(last_group + 1), per(links),
                          np.zeros(len(chunks), np.int64)], 1).astype(np.int64)
        self.sizes.frombytes(table.tobytes())
        self.ends.frombytes((links + len(self.pairs)).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())
        self.times.frombytes(np.ones(len(pairs), np.int64).tobytes())
        return True

    def add(self, text: str, ids_a: list[int], ids_b: list[int]) -> None:
        from collections import Counter

        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        raw = text.encode()
        if b"".join([bytes_a[i] for i in ids_a]) != raw or b"".join([bytes_b[i] for i in ids_b]) != raw:
            self.texts.append(b"")
            self.sizes.extend((0, 0, 0, 0, 1))
            self.ends.append(len(self.pairs))
            self.lost = True
            return
        groups, links, pairs = [], 0, Counter()
        i = j = end_a = end_b = from_a = from_b = 0
        while i < len(ids_a):
            if end_a <= end_b:
                end_a += len(bytes_a[ids_a[i]])
                i += 1
            while end_b < end_a:
                end_b += len(bytes_b[ids_b[j]])
                j += 1
            if end_a == end_b:
                own_a, own_b = ids_a[from_a:i], ids_b[from_b:j]
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links += len(own_a) * len(own_b)
                if len(own_a) == 1 and len(own_b) == 1:
                    pairs[own_a[0] << SHIFT | own_b[0]] += 1
                else:
                    times_b = Counter(own_b).items()
                    for a, n in Counter(own_a).items():
                        for b, m in times_b:
                            pairs[a << SHIFT | b] += n * m
                from_a, from_b = i, j
        self.texts.append(";".join(groups).encode())
        self.sizes.extend((len(ids_a), len(ids_b), len(groups), links, 0))
        self.pairs.extend(pairs.keys())
        self.times.extend(pairs.values())
        self.ends.append(len(self.pairs))

    def chunks(self, texts: list[str]) -> list:
        """The numbers of the chunks of each text, in order; none for an empty text."""
        np = self.np
        cut = [self.joints.split(t) if t else [] for t in texts]
        every = [chunk for own in cut for chunk in own]
        self.learn([chunk for chunk in dict.fromkeys(every) if chunk not in self.number])
        numbers = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        ends = np.cumsum(list(map(len, cut))).tolist()
        numbers = [numbers[start:end] for start, end in zip([0, *ends], ends)]
        return [self.whole(t, own) for t, own in zip(texts, numbers)] if self.lost else numbers

    def whole(self, text: str, own):
        """A text with a chunk whose bytes are not kept is aligned as a whole, so that the rule holds for all its bytes."""
        if not self.table()[own, 4].any():
            return own
        self.add(" " + text, self.encode_a(" " + text), self.b.encode(text))
        return self.np.array([len(self.texts) - 1]) if not self.sizes[-1] else own[:0]

    def table(self):
        return self.np.frombuffer(self.sizes, self.np.int64).reshape(-1, 5)

    def pairs_of(self, numbers):
        """(pairs, times, first place of each chunk) of chunks one after the other."""
        np = self.np
        ends = np.frombuffer(self.ends, np.int64)
        start, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(int(size.sum()))
        return np.frombuffer(self.pairs, np.int64)[at], np.frombuffer(self.times, np.int64)[at], first


def _aligner(name_a: str, name_b: str) -> Aligner:
    cache, paths = worker_cache(), (vocabulary_path(name_a), vocabulary_path(name_b))
    if ("aligner", paths) not in cache:
        cache["aligner", paths] = Aligner(*paths)
    return cache["aligner", paths]


def _first_pass(name_a: str, name_b: str, ids):
    """Texts in blocks of bounded size, and for each block the documents that hold each pair linked."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, names = _aligner(name_a, name_b), ["block", "doc_id", "text", "pair", "n"]
        part, block, size, seen = TaskContext.get().partitionId(), 0, 0, []

        def counted():
            pairs, n = np.unique(np.concatenate(seen), return_counts=True)
            for at in range(0, len(pairs), 50_000):
                own = pairs[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), part << 32 | block)), pa.nulls(len(own), ids),
                    pa.nulls(len(own), pa.string()), pa.array(own), pa.array(n[at:at + 50_000])], names=names)

        for batch in slices(batches, 256):
            if not seen and len(aligner.number) > KEPT_CHUNKS:
                aligner.clear()
            texts = batch.column(1).to_pylist()
            for own in aligner.chunks(texts):
                seen.append(np.unique(aligner.pairs_of(np.unique(own))[0]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(texts), part << 32 | block)), batch.column(0), batch.column(1),
                pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())], names=names)
            size += sum(map(len, texts))
            if size >= BLOCK_CHARS or len(seen) >= BLOCK_DOCS or len(aligner.number) >= BLOCK_CHUNKS:
                yield from counted()
                block, size, seen = block + 1, 0, []
        if seen:
            yield from counted()

    return run


def _second_pass(name_a: str, name_b: str):
    """Align the texts of each block again, beside the counts of its pairs, which come first."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        aligner, block, known = _aligner(name_a, name_b), None, []

        def sums_of(values, places):
            """Sums of the rows between successive places."""
            running = np.zeros((len(values) + 1, values.shape[1]), np.int64)
            np.cumsum(values, axis=0, out=running[1:])
            return np.diff(running[places], axis=0)

        for batch in slices(batches, 1024):
            blocks = batch.column(0).to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, stop in zip(turns, turns[1:]):
                rows = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, known = blocks[start], []
                    if len(aligner.number) > KEPT_CHUNKS:
                        aligner.clear()
                docs = rows.column(3).null_count
                if docs < rows.num_rows:
                    some = rows.slice(0, rows.num_rows - docs)
                    known.append(tuple(some.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)))
                if not docs:
                    continue
                rows = rows.slice(rows.num_rows - docs)
                if len(known) > 1:
                    known = [tuple(np.concatenate(c) for c in zip(*known))]
                pairs, counts, best = known[0] if known else [np.zeros(0, np.int64)] * 3
                own = aligner.chunks(rows.column(2).to_pylist())
                lengths = np.array([len(x) for x in own])
                all_chunks = np.concatenate([np.zeros(0, np.int64), *own])
                numbers, back = np.unique(all_chunks, return_inverse=True)
                found, times, first = aligner.pairs_of(numbers)
                place = np.searchsorted(pairs, found)
                if len(found) and (not len(pairs) or (pairs[np.minimum(place, len(pairs) - 1)] != found).any()):
                    raise ValueError("a pair of the second pass has no count")
                values = np.stack([times * best[place], times * counts[place]], 1) if len(found) else np.zeros((0, 2), np.int64)
                totals = sums_of(values, np.append(first, len(found)))
                values = np.concatenate([aligner.table()[numbers, :4], totals], 1)[back.reshape(-1)]
                sums = sums_of(values, np.cumsum([0, *lengths]))
                text_of = aligner.texts.__getitem__
                shas = [hashlib.sha256(b";".join(map(text_of, x.tolist()))).hexdigest() if len(x) else "" for x in own]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1), *[pa.array(sums[:, i]) for i in range(6)], pa.array(shas, pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _function_of(pdf):
    """The perfect hash function of a bucket of distinct pairs, and the pairs by slot."""
    import numpy as np
    import pandas as pd

    pairs = pdf["pair"].to_numpy(np.int64)
    hashed = PerfectHash.build(pairs)
    by_slot = np.zeros(len(pairs), np.int64)
    by_slot[hashed.slots(pairs)] = pairs
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "keys": [len(pairs)], "function": [hashed.to_bytes()],
                         "pairs": [by_slot.tobytes()]})


def _vector_of(rows, function):
    """The dense vector of counts of a lane's rows, by slot."""
    import numpy as np
    import pandas as pd

    if not len(rows) or not len(function):
        return pd.DataFrame({"bucket": np.zeros(0, int), "lane": np.zeros(0, int), "counts": np.zeros(0, object)})
    counts = np.zeros(int(function["keys"].iloc[0]), np.int64)
    slots = PerfectHash.from_bytes(function["function"].iloc[0]).slots(rows["pair"].to_numpy(np.int64))
    np.add.at(counts, slots, rows["n"].to_numpy(np.int64))
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "lane": [rows["lane"].iloc[0]], "counts": [counts.tobytes()]})


def _sum_of(pdf):
    import numpy as np
    import pandas as pd

    total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "lane": [pdf["lane"].iloc[0]], "counts": [total.tobytes()]})


def _looked_up(rows, function):
    """The counts of a lane's pairs; the pair kept in the slot must be the one asked for."""
    import numpy as np
    import pandas as pd

    if not len(rows) or not len(function):
        return pd.DataFrame({c: np.zeros(0, int) for c in ("block", "pair", "count")})
    pairs, kept = rows["pair"].to_numpy(np.int64), np.frombuffer(function["pairs"].iloc[0], np.int64)
    slots = PerfectHash.from_bytes(function["function"].iloc[0]).slots(pairs)
    if (slots < 0).any() or (kept[slots] != pairs).any():
        raise ValueError("a pair is not the one its slot was built for")
    return pd.DataFrame({"block": rows["block"], "pair": pairs,
                         "count": np.frombuffer(function["counts"].iloc[0], np.int64)[slots]})


def _unpacked(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (pairs, counts)],
                                             names=["pair", "count"])


def pair_counts(partial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (block, pair, n): the hash functions with their counts, and the rows with their bucket and lane.

    The distinct pairs are dealt to buckets by hash, and each bucket gets a minimal perfect hash function. Rows of a
    bucket are dealt to lanes, each of which adds at least LANE times as many rows as its dense vector has entries
    (one lane where there are fewer), so vectors stay small against the rows; a tree adds FAN of them at a time.
    """
    distinct = materialise(partial.select("pair").distinct(), "pairs")
    buckets = max(1, -(-distinct.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("pair"), F.lit(buckets)).cast("int").alias("bucket")
    functions = materialise(distinct.select(bucket, "pair").groupBy("bucket").applyInPandas(
        _function_of, "bucket int, keys long, function binary, pairs binary"), "functions")
    rows = partial.select(bucket, "block", "pair", "n")
    lanes = rows.groupBy("bucket").agg(F.count("*").alias("rows")).join(functions.select("bucket", "keys"), "bucket").select(
        "bucket", F.greatest(F.lit(1), F.floor(F.col("rows") / (LANE * F.col("keys")))).cast("int").alias("lanes"))
    lanes = materialise(lanes, "lanes")
    rows = rows.join(lanes, "bucket").select("bucket", F.pmod(F.xxhash64("block"), "lanes").cast("int").alias("lane"),
                                             "block", "pair", "n")
    dealt = functions.join(lanes, "bucket").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    vectors = materialise(rows.groupBy("bucket", "lane").cogroup(dealt.groupBy("bucket", "lane")).applyInPandas(
        _vector_of, "bucket int, lane int, counts binary"), "vectors")
    most = lanes.agg(F.max("lanes")).first()[0] or 1
    while most > 1:
        most = -(-most // FAN)
        vectors = materialise(vectors.withColumn("lane", F.floor(F.col("lane") / FAN).cast("int")).groupBy(
            "bucket", "lane").applyInPandas(_sum_of, "bucket int, lane int, counts binary"), "vectors")
    return materialise(dealt.join(vectors.select("bucket", "counts"), "bucket").drop("lanes"), "counted"), rows


def align_tokenizers(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers encode a space and the text, special strings as plain text; byte offsets at which tokens of both end
    cut the tokens into groups, and all pairs of tokens of a group are links. A pair of ids counts the documents of the
    corpus that hold it linked. n_best are the links whose count is the highest of their id of the first tokenizer
    (ties included), count_sum the counts of all links.

    Pass one aligns every text where it is read and writes the texts in blocks of bounded size, each with its
    documents per pair, so a pair that every document holds is one row a block. `pair_counts` numbers the distinct pairs
    by minimal perfect hash functions and adds dense vectors in a tree. The blocks' pairs look their counts up, each
    verified against the pair kept in its slot, and meet the texts of their block again for pass two, which aligns anew.
    What is broadcast is the highest count of each id of the first tokenizer, at most its vocabulary.

    Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and "". Rows that
    repeat an id are documents of their own; null ids are kept. An empty table gives no rows. Other columns are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col)
    ids = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    passed = materialise(rows.mapInArrow(
        _first_pass(vocabulary_a, vocabulary_b, to_arrow_type(ids)),
        f"block long, doc_id {ids.simpleString()}, text string, pair long, n long"), "aligned")
    functions, partial = pair_counts(passed.where(F.col("pair").isNotNull()).select("block", "pair", "n"))
    first_id = F.shiftrightunsigned("pair", SHIFT)
    highest = F.broadcast(materialise(functions.select("bucket", "lane", "pairs", "counts").where("lane = 0").select(
        "pairs", "counts").mapInArrow(_unpacked, "pair long, count long").groupBy(first_id.alias("a")).agg(
        F.max("count").alias("most")), "highest"))
    known = partial.groupBy("bucket", "lane").cogroup(functions.groupBy("bucket", "lane")).applyInPandas(
        _looked_up, "block long, pair long, count long").join(highest, first_id == F.col("a"))
    known = known.select("block", F.lit(None).cast(ids).alias("doc_id"), F.lit(None).cast("string").alias("text"), "pair",
                         "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    texts = passed.where(F.col("pair").isNull()).select(
        "block", "doc_id", "text", "pair", F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("best"))
    return known.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last()).mapInArrow(
        _second_pass(vocabulary_a, vocabulary_b),
        f"doc_id {ids.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")
