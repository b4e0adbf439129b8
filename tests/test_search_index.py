"""Ranked keyword search by blocks, and the index that follows changes of the catalogue."""

import math
import random

import pytest

from tradewind.operators import search as S
from tradewind.sources import search_index as SI

COLUMNS = ("id string, name string, category_name string, brand string, description string, price double, rating double, "
           "status string")
WORDS = ["lamp", "desk", "chair", "oak", "red", "blue", "steel", "soft", "rug", "shelf"]


def catalogue(n, seed):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    return [(f"p{i:03d}", text(4), text(3), rng.choice(["oak", "acme"]), text(12), float(rng.randrange(1000)),
             rng.choice([None, 1.0, 3.0, 4.5]), "GONE" if i % 9 == 0 else "ACTIVE") for i in range(n)]


def asked(spark, *queries):
    rows = [(str(i), *(q if isinstance(q, tuple) else (q, None, None, None))) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id string, query string, min_price double, max_price double, min_rating double")


QUERIES = ["lamp", "oak", "red desk", "steel rug soft", ("oak", None, 300.0, None), ("lamp", 200.0, 900.0, 3.0), "lamp nothing", "the"]


def plain(rows, query, by_length=False):
    """Score of each matching product, in millionths."""
    words, lo, hi, stars = query if isinstance(query, tuple) else (query, None, None, None)
    out = {}
    for i, name, category, brand, description, price, rating, status in rows:
        if status != "ACTIVE" or (lo and price < lo) or (hi and price > hi) or (stars and (rating or 0) < stars):
            continue
        fields = [(x.split(), w) for x, w in ((name, 10), (category, 10), (brand, 4), (description, 2))]
        length, total = sum(len(f) for f, _ in fields), 0
        for word in words.split():
            weight = sum(100_000 * w * f.count(word) // (f.count(word) + 1) for f, w in fields)
            if not weight:
                break
            total += math.floor(weight / (1 + math.log(1 + length))) if by_length else weight
        else:
            out[i] = total
    return {} if words == "the" else out


def best(rows, k, by_length=False):
    return {(str(q), i, rank + 1): s for q, query in enumerate(QUERIES)
            for rank, (i, s) in enumerate(sorted(plain(rows, query, by_length).items(), key=lambda x: (-x[1], x[0]))[:k])}


def found(df):
    return {(r.query_id, r.id, r["rank"]): round(r.score * 1e6) for r in df.collect()}


@pytest.mark.parametrize("first", [1, 20, 100_000])
def test_best_matches_by_frequency(spark, monkeypatch, first):
    monkeypatch.setattr(S, "FIRST_ROWS", first)
    monkeypatch.setattr(S, "PIECE_ROWS", 7)
    rows = catalogue(150, 1)
    products, q = spark.createDataFrame(rows, COLUMNS), asked(spark, *QUERIES)
    index = SI.build_search_index(products)
    for by_length in (False, True):
        assert found(S.full_text_search(q, index, 6, by_length=by_length)) == best(rows, 6, by_length)
        assert found(S.full_text_search(q, S.postings(products), 6, by_length=by_length)) == best(rows, 6, by_length)
    every = {(r.query_id, r.id): round(r.score * 1e6) for r in S.full_text_matches(q, S.postings(products)).collect()}
    assert every == {(str(n), i): s for n, query in enumerate(QUERIES) for i, s in plain(rows, query).items()}


def test_blocks_that_cannot_reach_the_kth_score_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_ROWS", 1)
    rows = [(f"p{i:04d}", "lamp" if i % 50 == 0 else "", "", "", "lamp " * (i % 7 + 1), 1.0, 1.0, "ACTIVE") for i in range(700)]
    products, q = spark.createDataFrame(rows, COLUMNS), asked(spark, "lamp")
    wanted, hits = S._terms(q), S.postings(products)
    plan = S._block_plan(wanted, S.term_blocks(hits), 5, False)
    blocks = plan.collect()
    assert len(blocks) > 5 and sum(r["_first"] for r in blocks) == 1  # the highest level holds five postings
    first = S.top_k(S._in_blocks(plan.filter("_first"), wanted, hits, "weight"), ["query_id"], [S.F.col("score").desc(), S.F.col("id")], 5)
    second = S._second_blocks(plan, first, 5).collect()
    assert len(second) + 1 < len(blocks) and sum(r.n for r in second) < 700 / 2
    cheap = asked(spark, ("lamp", 2.0, None, None))  # no block holds a product of that price
    assert S._block_plan(S._terms(cheap), S.term_blocks(hits), 5, False).count() == 0


def live(spark, index):
    return sorted(tuple(r) for r in index.postings(spark).select("product_id", "term", "weight", "by_length", "price").collect())


def test_batches_equal_a_rebuild_and_touch_changed_products_only(spark):
    rows = catalogue(120, 2)
    products = spark.createDataFrame(rows, COLUMNS)
    index = SI.build_search_index(products)
    first = live(spark, index)
    state, snapshots = {r[0]: r for r in rows}, [(index, first)]
    rng = random.Random(3)
    for batch in range(5):
        changed = [(r[0], r[1] + " velvet", f"renamed{batch}", *r[3:7], rng.choice(["ACTIVE", "GONE"])) for r in rng.sample(list(state.values()), 7)]
        changed += [(f"new{batch}", "velvet lamp", "rugs", None, None, 5.0, None, "ACTIVE")]
        gone = rng.sample(sorted(state), 3) + ["unknown"]
        new = SI.update_search_index(spark, index, spark.createDataFrame(changed, COLUMNS),
                                     spark.createDataFrame([(i,) for i in gone], "id string"))
        state.update({r[0]: r for r in changed})
        state = {i: r for i, r in state.items() if i not in gone}
        now = spark.createDataFrame(list(state.values()), COLUMNS)
        assert live(spark, new) == sorted(tuple(r) for r in S.postings(now).select("product_id", "term", "weight", "by_length", "price").collect())
        if batch == 0:  # the new segment holds the changed products alone
            own = spark.read.parquet(f"{new.root}/postings/segment={new.segments[-1][0]}")
            assert {r.product_id for r in own.select("product_id").distinct().collect()} <= {r[0] for r in changed}
        index = SI.open_search_index(spark, new.root)
        assert index == new
        snapshots.append((index, live(spark, index)))
    assert len(index.segments) <= 3  # small segments were merged
    for old, want in snapshots:
        assert live(spark, old) == want
    q = asked(spark, "velvet", "lamp", ("rug", None, 500.0, None))
    assert found(S.full_text_search(q, index, 4)) == found(S.full_text_search(q, S.postings(now), 4))


def test_empty_index(spark):
    none = spark.createDataFrame([], COLUMNS)
    index = SI.build_search_index(none)
    assert S.full_text_search(asked(spark, "lamp"), index, 3).collect() == []
    new = SI.update_search_index(spark, index, spark.createDataFrame(catalogue(5, 4), COLUMNS))
    assert live(spark, new) and SI.open_search_index(spark, index.root, 0) == index
