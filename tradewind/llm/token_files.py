"""Token ids in flat binary files with 64-bit document offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import NO_ID, id_and_text, slices, vocabulary_path, worker_cache

CACHED_WORDS = 500_000
MARKS = ".,;:!?"


class TokenEncoder:
    """Bytes of the ids of a text; remembers the ids of the words that stand between white space.

    The vocabularies this is meant for drop white space and never join what ASCII white space separates, so the ids
    of a text are those of its words in turn. Some CACHED_WORDS latest words and as many older ones are remembered;
    the library encodes what is new. Words of letters alone go to it many in one text: where every word ends in a
    token with the vocabulary's end-of-word suffix, these tokens cut the ids into words again. Marks behind
    such a word are pieces of their own.
    """

    def __init__(self, path: str, id_bytes: int):
        import json
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {1: "B", 2: "H", 4: "I"}[id_bytes]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of every word, asked for one by one."""
        from array import array

        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array(self.kind, c.ids).tobytes() for c in coded]

    def together(self, words: list[str], at_once: int = 512) -> list[bytes]:
        """The ids of words of letters, many words in one text."""
        import numpy as np

        parts = [words[i:i + at_once] for i in range(0, len(words), at_once)]
        out = []
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(
                [" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(coded.ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ids.max(initial=0) > np.iinfo(self.kind).max:
                out += self.each(part)  # a word that is more than one piece, or an id that does not fit
                continue
            data, size = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            stops = (ends * size).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        plain, marked, odd = {}, [], []
        for word in words:
            if word in known:
                continue
            if (found := older.get(word)) is not None:
                known[word] = found
            elif word.isalpha():
                plain[word] = None
            else:
                core = word.rstrip(MARKS)
                if core.isalpha() and core[-1].lower().isalpha():
                    marked.append((word, core, word[len(core):]))
                    if core not in known:
                        plain[core] = None
                else:
                    odd.append(word)
        known.update(zip(plain, self.together(list(plain))))
        known.update(zip(odd, self.each(odd)))
        for word, core, marks in marked:
            if marks not in self.marks:
                self.marks[marks] = self.each([marks])[0]
            known[word] = known[core] + self.marks[marks]
        return [known[w] for w in words]

    def encode(self, texts):
        """All ids of an Arrow array of texts, one text after the other, and where each text ends."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        pieces = self.look_up(coded.dictionary.to_pylist())
        size = np.dtype(self.kind).itemsize
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // size
        starts, sizes = np.cumsum(lengths) - lengths, lengths[which]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        words = np.cumsum(pc.list_value_length(cut).to_numpy())
        return np.frombuffer(b"".join(pieces), self.kind)[at], np.concatenate([[0], ends])[words]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1,
                      id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents below `path`, in ascending id order (null ids first, ties by content hash).

    Layout: `shard=N/part=ids/` holds one flat file of unsigned little-endian integers of `id_bytes` bytes (2 or
    4), every document closed by `end_id`; `shard=N/part=offsets/` one file of 64-bit integers, the documents'
    starts within the shard and at last its length; `shard=N/part=docs/` the documents' 64-bit ids (null: -2^63).
    The last two files end with one more `end_id`. Shards are ranges of the ids by sampled splitters.

    Spark's own text writer puts the bytes down, with the end id as its line separator: every store that Spark
    writes works, and its commit protocol drops the files of lost or repeated tasks. Null texts are empty
    documents of one id. An empty table writes no shard. Other columns are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = [F.col("doc_id"), F.xxhash64("text")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache, file = worker_cache(), vocabulary_path(vocabulary)
        if ("encoder", file, id_bytes) not in cache:
            cache["encoder", file, id_bytes] = TokenEncoder(file, id_bytes)
        encoder = cache["encoder", file, id_bytes]
        shard, row, ids, sizes = TaskContext.get().partitionId(), 0, [], []

        def out(part, values):
            nonlocal row
            row += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part]), pa.array([row], pa.int64()), pa.array([values], pa.binary())],
                names=["shard", "part", "row", "bytes"])

        for batch in slices(batches, 2048):
            coded, ends = encoder.encode(batch.column(1))
            ids.append(np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], "<i8"))
            sizes.append(np.diff(ends, prepend=0) + 1)
            # the writer closes the last document with the end id
            yield out("ids", np.insert(coded, ends[:-1], end_id).tobytes())
        if ids:
            starts = np.concatenate([np.zeros(1, "<i8"), np.cumsum(np.concatenate(sizes), dtype="<i8")])
            yield out("offsets", starts.tobytes())
            yield out("docs", np.concatenate(ids).tobytes())

    end = end_id.to_bytes(id_bytes, "little").decode("ascii")
    order = ["shard", "part", "row"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, "shard int, part string, row long, bytes binary").sortWithinPartitions(*order).select(
        "shard", "part", F.col("bytes").cast("string").alias("value")).write.partitionBy("shard", "part").option(
        "lineSep", end).text(path)


def token_shards(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """One row per shard: shard, base (ids of all shards before it), n_ids, n_docs, and the paths of its files.

    Only file names and lengths are read; bases are prefix sums over the shards, a few bytes each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"),
        F.regexp_extract("path", r"/part=(\w+)/", 1).alias("part"), "path", "length").where(F.col("part") != "")
    of = lambda part, col: F.max(F.when(F.col("part") == part, F.col(col)))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("shard").agg(
        (of("ids", "length") / id_bytes).cast("long").alias("n_ids"),
        ((of("docs", "length") - id_bytes) / 8).cast("long").alias("n_docs"),
        of("ids", "path").alias("ids"), of("offsets", "path").alias("offsets"), of("docs", "path").alias("docs"),
    ).withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents of the files below `path`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    `with_ids` adds the ids as an array. Every task maps the files of its shards into memory, so `path` must be a
    folder that all executors mount; the files of any other store are handed to the tasks as bytes by Spark.
    ids_crc32 is the unsigned crc32 of the ids as 32-bit little-endian integers.
    """
    shards = token_shards(spark, path, id_bytes)
    mounted = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark._jsc.hadoopConfiguration()).getScheme() == "file"
    parts = ["ids", "offsets", "docs"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not mounted:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        for p in parts:
            shards = shards.join(content.select(F.col("path").alias(p), F.col("content").alias(f"{p}_bytes")), p)
        shards = shards.select("base", *[F.col(f"{p}_bytes").alias(p) for p in parts])
    else:
        shards = shards.select("shard", "base", *parts).repartition(tasks, "shard").select("base", *parts)
    kind, schema = f"<u{id_bytes}", "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        def view(file, kind, tail):
            if isinstance(file, bytes):
                values = np.frombuffer(file, np.uint8)
            else:
                values = np.memmap(file.removeprefix("file:").replace("//", "/"), np.uint8, "r")
            return values[:len(values) - tail].view(kind)

        for batch in batches:
            for base, ids, offsets, docs in zip(*(c.to_pylist() for c in batch.columns)):
                ids, offsets, docs = view(ids, kind, 0), view(offsets, "<i8", id_bytes), view(docs, "<i8", id_bytes)
                for at in range(0, len(docs), 1024):
                    own = docs[at:at + 1024]
                    starts, ends = offsets[at:at + len(own)], offsets[at + 1:at + len(own) + 1]
                    each = [ids[a:b].astype("<u4") for a, b in zip(starts, ends)]
                    columns = [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(starts + base, pa.int64()),
                               pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return shards.mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))
