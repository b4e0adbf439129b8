import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import alignment as module
from tradewind.llm.alignment import align_tokenizers
from tradewind.llm.perfect_hash import PerfectHash
from tradewind.llm.token_counts import byte_letters

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(texts):
    """Whole texts through both libraries, groups by the byte offsets at which both end."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: i for i, c in enumerate(byte_letters())}
    docs, held = [], Counter()
    for text in texts:
        raw, groups = (" " + text).encode() if text else b"", []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                   for i in ids_b]
        if b"".join(bytes_a) == raw == b"".join(bytes_b):
            ends = [np.cumsum([len(x) for x in own], dtype=int).tolist() for own in (bytes_a, bytes_b)]
            before = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                groups.append(tuple([i for i, e in zip(ids, own) if before < e <= end]
                                    for ids, own in zip((ids_a, ids_b), ends)))
                before = end
        docs.append(groups)
        held.update({(x, y) for own_a, own_b in groups for x in own_a for y in own_b})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, rows, df):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(df).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows])))


ODD = [None, "", " ", "   two  spaces ", "▁", "a ▁b c", "<|endoftext|> and <s> </s> <unk> <0x41>", "don't 's it 've", "tab\tnew\nline\r\n x",
       "É è ñ ß 漢字 🙂 ​　x \xa0y", "x\x1cy \x85 z\x00", "a" * 3000, "1234567890 12345 3.14", "…", "🙂" * 50, "the " * 400]


def test_odd_texts_against_whole_texts(spark, make):
    rows = list(enumerate(ODD))
    check(spark, rows, make(rows))


@pytest.mark.parametrize("small", [False, True])
def test_documents_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks a task, buckets, lanes and levels of the tree
        for name, value in (("BLOCK_CHARS", 20_000), ("KEPT_CHUNKS", 50), ("BUCKET", 300), ("LANE", 1), ("FAN", 2)):
            monkeypatch.setattr(module, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("one < two")}))
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_repeats_nulls_and_empty_tables(make):
    rows = align_tokenizers(make([(1, "one two"), (1, "one two"), (None, "two"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in rows) == [(0, 1, 3), (1, 2, 5), (1, 2, 5), (2, 0, 0)]
    assert align_tokenizers(make([])).collect() == []
    assert sorted(r.n_links for r in align_tokenizers(make([(1, None), (2, "")])).collect()) == [0, 0]


def test_perfect_hash_numbers_each_key_once(rng):
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.array(sorted({rng.randrange(-2 ** 62, 2 ** 62) for _ in range(n)}), np.int64)
        hashed = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(hashed.slots(keys)) == list(range(n))
        assert hashed.slots(np.array([2 ** 62 + 5])).max() < max(n, 1)
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3]))


def test_many_chunks_at_once_as_each_by_itself(rng):
    from tradewind.llm.alignment import Aligner, byte_pair_encoder
    from tradewind.llm.common import vocabulary_path

    path = vocabulary_path("byte_bpe_50k.json")
    encode, exact = byte_pair_encoder(path)  # so the tokens of the first side need no joining
    assert exact and len(encode("née 日本 \x00")) > 3
    letters = "abcdefghé日ñ.,-<|>012🙂\n\t"
    chunks = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(1200)))
    together, single = (Aligner(path, vocabulary_path("piece_bpe_32k.model")) for _ in range(2))
    together.learn(chunks)
    for chunk in chunks:
        single.add(" " + chunk, single.encode_a(" " + chunk), single.b.encode(chunk))
    assert together.texts == single.texts and (together.table() == single.table()).all()
    assert [together.number[c] for c in chunks] == list(range(1, len(chunks) + 1))
