from collections import defaultdict

import pytest

from tradewind.llm import mixing as module
from tradewind.llm.mixing import mix_sources, mixed_documents, source_targets


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    targets, total = {}, float(sum(sizes.values()))
    while True:
        rest = [n for n in names if n not in targets]
        left = total - sum(targets.values())
        share = {n: left * weight[n] / sum(weight[r] for r in rest) for n in rest}
        over = [n for n in rest if share[n] > cap * sizes[n]]
        if not over:
            return targets | share
        targets |= {n: cap * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 50}, {"é": 7, "z": 10_000, "a": 3, "b": 0, "Z": 900},
    {"a": 0}, {"x": 5}, {f"s{i}": i * i for i in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    if sum(sizes.values()):
        assert got == pytest.approx(plain_targets(sizes))
    else:
        assert set(got.values()) == {0.0}


def documents(rng, n=400):
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 300, 700, 3000]) if i % 50 else 9000
        rows.append((i, " ".join(["w"] * size), rng.choice(["hot"] * 6 + ["b", "c", None])))
    return rows


def test_sources_come_near_their_targets(make, rng, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    rows = documents(rng)
    first = mix_sources(make(rows)).collect()
    again = mix_sources(make(rows[::-1]).repartition(7)).collect()
    assert sorted(first) == sorted(again)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    names = {r[0]: r[2] for r in rows}
    for r in first:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken in {k * r["size"] for k in range(4)}
        sizes[names[r.doc_id]] += r["size"]
        taken[names[r.doc_id]] += r.taken
        targets[names[r.doc_id]] = r.target
    want = plain_targets(sizes)
    assert targets == pytest.approx(want)
    assert abs(taken["hot"] - want["hot"]) <= 300  # lighter documents make up for the heavy ones
    assert all(abs(taken[s] - want[s]) <= 3000 for s in sizes)
    assert all(r.source_size == sizes[names[r.doc_id]] for r in first)


def test_chances_are_kept(make, rng):
    rows = [(i, "w " * rng.randrange(1, 60), "ab"[i % 2]) for i in range(60)]
    count = defaultdict(int)
    for seed in range(6):
        for r in mix_sources(make(rows), seed=seed).collect():
            count[r.doc_id] += r.copies
    expected = {r.doc_id: r.target / r.source_size for r in mix_sources(make(rows)).collect()}
    for half in (0, 1):
        own = [d for d in expected if d % 2 == half]
        assert sum(count[d] for d in own) / 6 / len(own) == pytest.approx(sum(expected[d] for d in own) / len(own), abs=0.12)


def test_odd_rows(make):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", "b"), (None, "q", "b")]
    got = mix_sources(make(rows)).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    assert len({r.copies for r in got if r.doc_id == 3}) == 1
    assert mix_sources(make([])).collect() == []
    assert {r.taken for r in mix_sources(make([(1, "", "a"), (2, None, None)])).collect()} == {0}


def test_the_mix_repeats_whole_documents(make, rng):
    docs = make(documents(rng, 80))
    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    mixed, found = mixed_documents(docs), defaultdict(int)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        found[r.doc_id] += 1
    assert dict(found) == {d: n for d, n in copies.items() if n}
