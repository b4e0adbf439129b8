import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tradewind.llm.token_counts import TokenCounter, count_merged, token_counts

from .conftest import by_id

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_merging_takes_the_lowest_rank_first_and_the_leftmost_of_ties():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("a", "a"): 3}
    assert count_merged(list("abc"), ranks) == 1
    assert count_merged(list("ababc"), ranks) == 2
    assert count_merged(list("aaaaa"), ranks) == 3
    assert count_merged([], ranks) == 0


def test_every_character_beside_others(library):
    counter, rng = TokenCounter(PATH), random.Random(3)
    for cp in [*range(0x250), 0x1680, 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF,
               *(rng.randrange(0x10FFFF) for _ in range(3000))]:
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c}b {c} 1{c}  {c}\n{c}"
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(cp)


def test_tables_of_odd_texts(make, rng, library):
    letters = " \n\t'sdtrevma1<|endoftext|>é\x1c\xa0.#"
    texts = ["", None, " ", "a" * 50_000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 30_000, "x\n" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = by_id(token_counts(make(rows), limit=20))
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[doc_id]["n_bytes"], got[doc_id]["n_tokens"], got[doc_id]["over_limit"]) == (
            len((text or "").encode()), n, n > 20)


def test_repeated_rows_and_empty_tables(make):
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(make([(1, "a b"), (1, "a b"), (None, "a")])).collect()
                  ) == [(0, 1), (1, 2), (1, 2)]
    assert token_counts(make([])).collect() == []
