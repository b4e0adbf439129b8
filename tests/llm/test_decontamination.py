import re
from itertools import combinations

import numpy as np
import pytest

from tradewind.llm import decontamination
from tradewind.llm.decontamination import (
    MASKS, WordHashes, contaminated_documents, decontaminate, masks_for, masks_of, seed_hashes, token_runs)


def tokens(text):
    return [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]


def brute(rows, items, window=20, similarity=0.8):
    out = {}
    for doc_id, text in rows:
        doc, hit = tokens(text), set()
        for item, item_text in items:
            own = tokens(item_text)
            size = min(window, len(own))
            if len(own) < 5:
                continue
            for shift in range(-len(own) + size, len(doc) - size + 1):
                same = [doc[k + shift] == own[k] for k in range(max(0, -shift), min(len(own), len(doc) - shift))]
                if any(sum(same[k:k + size]) >= similarity * size for k in range(len(same) - size + 1)):
                    hit.add(item)
                    break
        if hit:
            out[doc_id] = sorted(hit)
    return out


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def test_texts_share_the_steps_of_a_run(monkeypatch):
    monkeypatch.setattr(decontamination, "RUN_TOKENS", 5)
    texts = ["A b, C!", "", "-- __", "d e f g", "h", "\u00df2 x_y"]
    runs = [(first, len(values), ends.tolist()) for first, values, ends in token_runs(texts, WordHashes())]
    assert runs == [(0, 7, [3, 3, 3, 7]), (4, 3, [1, 3])]
    assert list(token_runs([], WordHashes())) == []
    known = WordHashes()
    assert known["x_y"] == known["xy"] != known["--"] == 0


def test_a_passage_cut_by_a_text_s_end_is_not_found(make, bench):
    """Texts lie end to end in a run; a passage must not be put together from two of them."""
    item = " ".join(f"w{i}" for i in range(8))
    halves = [(1, "x w0 w1 w2 w3"), (2, "w4 w5 w6 w7 y"), (3, ""), (4, f"a b {item} c"), (5, item)]
    docs = make(halves).coalesce(1).sortWithinPartitions("doc_id")
    assert sorted(r.doc_id for r in contaminated_documents(docs, bench([(1, item)])).collect()) == [4, 5]


def test_seeds_ignore_masked_tokens():
    a, b = np.arange(9, dtype=np.uint64), np.arange(9, dtype=np.uint64)
    b[4] = 77
    assert (seed_hashes(a, "1111011") == seed_hashes(b, "1111011")).tolist() == [True, False, False]
    assert len(seed_hashes(a[:3], "1111011")) == 0
    assert masks_of([5, 5, 30, 7, 3])[-2:] == ["11111", "1111111"]


def test_against_laying_every_item_over_every_document(make, bench, rng):
    words = [f"w{i}" for i in range(400)] + ["of", "the", "a"] * 40
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.randrange(14, 60))) for i in range(30)] + [(40, text(5)), (41, text(6)), (42, text(8)), (43, text(3))]
    rows = []
    for i in range(150):
        doc = text(rng.randrange(80))
        if i % 2:
            item = list(rng.choice(items)[1])
            if i % 4 == 1 and len(item) > 10:  # one in six substituted, evenly
                for k in range(rng.randrange(6), len(item), 6):
                    item[k] = "changed"
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = item[:rng.choice([len(item), len(item), 12])]
        rows.append((i, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in doc)))
    rows += [(500, None), (501, ""), (502, "... --- !!!"), (503, " ".join(" ".join(t) for _, t in items * 40))]
    items = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, items[0][0] and " ".join(items[0][1]))]
    got = {r.doc_id: (r.item_ids, r.n_items, r.contaminated) for r in contaminated_documents(make(rows), bench(items)).collect()}
    want = brute(rows, [x for x in items if x[0] != 92])
    assert got == {d: (found, len(found), True) for d, found in want.items()}


def test_a_full_filter_costs_time_and_no_results(make, bench):
    item = " ".join(f"u{i}" for i in range(30))
    rows = [(1, "before " + item + " after"), (2, " ".join(f"v{i}" for i in range(300)))]
    got = contaminated_documents(make(rows), bench([(5, item)]), filter_bits=6).collect()
    assert [(r.doc_id, r.item_ids, r.overlap) for r in got] == [(1, [5], 1.0)]


def test_only_contaminated_documents_go(make, bench):
    item = " ".join(f"u{i}" for i in range(30))
    docs = make([(1, item), (1, "clean"), (None, item + " x"), (None, "clean"), (2, None), (3, "clean"), (3, "clean")])
    kept = decontaminate(docs, bench([(5, item)]))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "clean"), (1, "clean"), (2, ""), (3, "clean"), (3, "clean")]
    assert decontaminate(docs, bench([])).count() == 7
    assert contaminated_documents(make([]), bench([(5, item)])).collect() == []


@pytest.mark.parametrize("n", range(5, 21))
def test_every_allowed_substitution_leaves_a_mask_whole(n):
    ones = [sum(1 << at + i for i, c in enumerate(m) if c == "1") for m in masks_for(n) for at in range(n - len(m) + 1)]
    for changed in (c for k in range(n // 5 + 1) for c in combinations(range(n), k)):
        bits = sum(1 << i for i in changed)
        assert any(not mask & bits for mask in ones), changed


def test_short_items_with_substitutions(make, bench):
    """Every pattern of lengths 5 to 12, and of 15 to 17 those that the fixed masks alone would lose."""
    items, rows = [], []
    for n in (*range(5, 13), 15, 16, 17):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changed in combinations(range(n), n // 5):
            lost = [m for m in MASKS for at in range(n - len(m) + 1) if not any(
                0 <= c - at < len(m) and m[c - at] == "1" for c in changed)]
            if n < 13 or not lost:
                text = ["other" if k in changed else w for k, w in enumerate(item)]
                rows.append((len(rows), " ".join(["some", "words", *text, "and", "more"])))
    got = {r.doc_id: r.item_ids for r in contaminated_documents(make(rows), bench(items)).collect()}
    assert got == brute(rows, items) and len(got) == len(rows) > 200


def test_items_without_an_id_are_items(make, bench):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = make([(1, a), (2, f"{a} {b} {c}"), (3, c), (4, "clean")])
    items = bench([(None, a), (None, b), (7, c), (None, c)])
    got = {r.doc_id: (r.item_ids, r.n_items) for r in contaminated_documents(docs, items).collect()}
    assert got == {1: ([None], 1), 2: ([7, None, None], 3), 3: ([7], 1)}
    assert [r.doc_id for r in decontaminate(docs, items).collect()] == [4]
