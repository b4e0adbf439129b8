import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tradewind.llm.token_files import read_token_files, token_shards, write_token_files

LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def expected(rows, end=1):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_round_trip(spark, make, rng, tmp_path, id_bytes):
    letters = "aAbB '\"!é́Σς1\n\t\xa0\x1c<|endoftext|> "
    texts = [None, "", " ", '"', '" " "', "long " * 20_000, "é É", "a<|endoftext|>b", "ΑΣ ΑΣΑ", "don't DON'T", "A. a... É, é; K. ſ! x1. 1, .", "ǅ. İ. ß, ﬁ."]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(200)]
    rows = [(rng.randrange(10 ** 12) - 5 * 10 ** 11, t) for t in texts] + [(None, "no id")]
    path = str(tmp_path / "files")
    write_token_files(make(rows), path, id_bytes=id_bytes)
    got = read_token_files(spark, path, id_bytes, with_ids=True).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[1])
    assert [tuple(r) for r in got] == expected(rows)


def test_files_are_flat_and_bases_are_prefix_sums(spark, make, tmp_path):
    rows = [(i, f"word {i}") for i in range(500)]
    path = str(tmp_path / "files")
    write_token_files(make(rows), path)
    want, base = [i for r in expected(rows) for i in r[4]], 0
    found = []
    for shard in sorted(token_shards(spark, path).collect(), key=lambda r: r["shard"]):
        assert shard["base"] == base
        ids = np.memmap(shard["ids"].removeprefix("file:"), "<u2", "r")
        offsets = np.fromfile(shard["offsets"].removeprefix("file:"), "<i8", shard["n_docs"] + 1)
        assert offsets[0] == 0 and offsets[-1] == len(ids) == shard["n_ids"]
        assert (ids[offsets[1:] - 1] == 1).all()
        found += ids.tolist()
        base += len(ids)
    assert found == want


def test_bytes_from_another_store(spark, make, tmp_path):
    rows = [(i, f"text {i} of some") for i in range(50)]
    path = str(tmp_path / "files")
    write_token_files(make(rows), path)
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.far.link./in", str(tmp_path))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    got = read_token_files(spark, "viewfs://far/in/files").collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == [r[:4] for r in expected(rows)]


def test_repeated_ids_empty_tables_and_wide_ids(spark, make, tmp_path):
    rows = [(1, "same"), (1, "same"), (1, "other")]
    write_token_files(make(rows), str(tmp_path / "a"))
    got = sorted(tuple(r) for r in read_token_files(spark, str(tmp_path / "a")).select("doc_id", "start").collect())
    assert got == [(1, 0), (1, 2), (1, 4)]
    write_token_files(make([]), str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).collect() == []
    with pytest.raises(Exception, match="maximum"):
        write_token_files(make([(1, "some ordinary words")]), str(tmp_path / "c"), id_bytes=1)
