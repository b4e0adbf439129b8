import hashlib
from collections import Counter

import pytest

from tradewind.llm import suffix_dedup as module
from tradewind.llm.suffix_dedup import suffix_dedup

from .conftest import by_id


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = {}
    for (doc_id, _), t in zip(rows, texts):
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                cover[i:i + length] = [True] * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out[doc_id] = (len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows, length):
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(df).items()}
    assert got == brute(rows, length)


def test_against_all_substrings(make, rng):
    words = ["the", "erö", "and", "ñasco", "of", "x", "\n"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a" * 300), (3, "ab" * 100 + "c" + "ab" * 40), (4, "short")]
    for i in range(5, 80):
        t = text(rng.randrange(60))
        for p in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(len(p) // 2)
            t = t[:len(t) // 2] + p[cut:] + t[len(t) // 2:]
        rows.append((i, t))
    rows += [(100 + i, rows[10][1]) for i in range(5)] + [(200, rows[11][1][:-3] + "zzz")]
    check(suffix_dedup(make(rows), 40), rows, 40)


def test_large_ranks_take_the_split_paths(make, rng, monkeypatch):
    monkeypatch.setattr(module, "HELD", 10)
    monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(module, "CHUNK", 600)
    passage = "".join(rng.choice("abcd") for _ in range(90))
    letters = lambda n: "".join(rng.choice("efgh") for _ in range(n))
    rows = [(i, letters(rng.randrange(80)) + passage + letters(rng.randrange(80))) for i in range(60)]
    rows += [(100, letters(2500) + passage + letters(700) + passage[10:])]
    check(suffix_dedup(make(rows), 48), rows, 48)


def test_a_core_with_many_open_stretches(make, rng):
    """More than BLOCK different surroundings of one passage, some of which agree further to one side or the other."""
    letters = lambda n: "".join(rng.choice("efghß") for _ in range(n))
    passage, left, right = letters(45), [letters(24) for _ in range(4)], [letters(24) for _ in range(4)]
    rows = []
    for i in range(module.BLOCK + 60):
        before = letters(30) + rng.choice(left)[rng.randrange(24):]
        after = rng.choice(right)[:rng.randrange(24)] + letters(30)
        rows.append((i, before + passage + after))
    rows += [(1000 + i, rows[i][1]) for i in range(3)]
    check(suffix_dedup(make(rows), 48), rows, 48)


def test_repeated_ids_and_empty_tables(make):
    a, b = "x1y2z3" * 9, "".join(map(str, range(50)))
    got = suffix_dedup(make([(1, b), (1, b), (None, a), (None, "tiny")]), 24).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 54), (1, 90), (1, 90)]
    assert suffix_dedup(make([]), 24).collect() == []


def test_too_short_a_length_is_refused(make):
    with pytest.raises(ValueError):
        suffix_dedup(make([]), 20)
