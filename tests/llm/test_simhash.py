import re

import numpy as np
import pytest
import xxhash

from tradewind.llm import simhash as module
from tradewind.llm.simhash import bit_sliced_links, components, fingerprint, forest, key_layout, keep_one_of_each, simhash_dedup

from .conftest import by_id


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in prints}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c d", "a  B\tc\nd e", "É è Ñ x y z", "w " * 9000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 8, 10, 17])
def test_bit_sliced_links_are_all_pairs_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2 ** 63, 30, np.uint64)
    near = base[rng.integers(0, 30, 170)].copy()
    for _ in range(radius + 1):
        near ^= np.uint64(1) << rng.integers(0, 64, 170).astype(np.uint64)
    a, b = np.concatenate([base, near]), near[::2]
    for left, right, same in ((a, a, True), (a, b, False)):
        i, j = bit_sliced_links(left, right, radius, same)
        want = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
        if same:
            want = np.triu(want, 1)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_forest_finds_the_smallest_of_a_component(rng):
    n, i, j = 300, [], []
    for k in range(1, 250):
        i.append(k), j.append(rng.randrange(max(0, k - 20), k) if k % 40 else k)
    labels = forest(n, np.array(i), np.array(j))
    assert sorted(set(labels.tolist())) == [0, *range(40, 250, 40), *range(250, 300)]


def test_keys_grow_with_the_table_and_stay_exact():
    for n in (10, 10 ** 6, 10 ** 8, 10 ** 11):
        widths, k = key_layout(n, 4)
        assert sum(widths) == 64 and len(widths) == 4 + k
    assert key_layout(10, 4)[1] == 1 and key_layout(10 ** 11, 4)[1] > 2


def test_components_of_long_paths(spark, rng):
    order = list(range(200))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199) if i % 50 != 49] + [(7, 7)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for at in range(0, 200, 50):
        assert len({labels[x] for x in order[at:at + 50]}) == 1
    assert len(set(labels.values())) == 4


def test_against_all_pairs(make, rng, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)  # large buckets are dealt to blocks
    monkeypatch.setattr(module, "POOL", 5)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(30, 300))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "one"), (4, "One"), (5, "y " * 30_000)]
    for i in range(6, 160):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    got = by_id(simhash_dedup(make(rows)))
    prints = {d: plain_fingerprint(t) for d, t in rows}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(prints)


def test_one_of_each_stays_with_all_columns(make):
    text = " ".join(f"t{i}" for i in range(80))
    docs = make([(5, text), (3, text.upper()), (3, text), (9, text), (7, "other words here at all"), (7, "other words here at all"),
                 (None, "no id for this one here")])
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7]
    assert keep_one_of_each(make([])).collect() == []
