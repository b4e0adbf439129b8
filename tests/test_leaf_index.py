"""The stored vector index: searched as it is, changed leaf by leaf."""

import os

import numpy as np
import pytest

from tradewind.operators import vectors as V
from tradewind.sources import leaf_index as LI

from test_vectors import SCHEMA, plain, ranked


def clustered(n, dims, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dims))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    return [(f"{i:04d}", [float(x) for x in middles[i % clusters] + spread * rng.normal(size=dims)], f"c{i % 3}",
             "b" if i % 4 else None, float(i), float(i % 6)) for i in range(n)]


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, own in os.walk(root) for f in own}


@pytest.fixture
def stored(spark):
    rows = clustered(600, 12, 30, 3)
    return rows, LI.build_leaf_index(spark.createDataFrame(rows, SCHEMA), leaves=30)


def test_search_writes_nothing_of_the_index_and_equals_all_pairs(spark, stored):
    rows, index = stored
    before = files(index.root)
    queries = [{"query_id": f"q{r[0]}", "embedding": r[1], "max_price": 300.0 if i % 2 else None}
               for i, r in enumerate(clustered(60, 12, 30, 3, 0.1))]
    q = spark.createDataFrame([tuple(x.values()) for x in queries], "query_id string, embedding array<float>, max_price double")
    for k, threshold in ((10, 0.2), (1, -1.0), (40, 0.5)):
        assert ranked(V.vector_search(q, index, k, threshold)) == plain(queries, rows, k, threshold)
    assert files(index.root) == before
    reopened = LI.open_leaf_index(spark, index.root)
    assert reopened.snapshot == 0 and np.array_equal(reopened.centre, index.centre)
    assert ranked(V.vector_search(q, reopened, 3, 0.2)) == plain(queries, rows, 3, 0.2)


def test_second_pass_visits_few_leaves(spark, stored):
    rows, index = stored
    q = spark.createDataFrame([(r[0], r[1]) for r in rows[:90]], "query_id string, embedding array<float>")
    visits = V.leaf_visits(q, index, 10, 0.2).collect()
    assert len(visits) == 90 and all(r.leaves == (index.vectors > 0).sum() for r in visits)
    assert all(r["first"] <= 6 for r in visits)
    # the first pass finds ten near ones, and few of the other leaves can hold better
    assert sum(r["first"] + r["second"] for r in visits) < 0.4 * len(visits) * visits[0].leaves


def test_unvisited_leaves_are_not_read(spark, stored):
    _, index = stored
    few = index.manifest(spark).where("leaf < 2").select("leaf", "version")
    found = index.of_leaves(spark, few)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan
    assert {r.leaf for r in found.select("leaf").distinct().collect()} <= {0, 1}
    q = spark.createDataFrame([("q", [1.0] * 12)], "query_id string, embedding array<float>")
    plan = V._visit(spark, V._asked(q, index, 3, 0.2), index, 2, False)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_a_delta_writes_the_leaves_it_touches(spark, stored):
    rows, index = stored
    old = {r.id: r.price for r in index.rows(spark).collect()}
    before = files(f"{index.root}/vectors")
    moved = [(rows[5][0], [-x for x in rows[5][1]], "new", None, -1.0, None), ("zzzz", rows[8][1], "new", "X", -2.0, 1.0)]
    gone = spark.createDataFrame([(rows[7][0],), ("unknown",)], "id string")
    new = LI.update_leaf_index(spark, index, spark.createDataFrame(moved, SCHEMA), gone)
    added = set(files(f"{index.root}/vectors")) - set(before)
    leaves = {f.split("leaf=")[1].split("/")[0] for f in added if "leaf=" in f}
    assert 1 <= len(leaves) <= 4 and all("version=1" in f for f in added)
    assert {k: v for k, v in files(f"{index.root}/vectors").items() if k in before} == before
    want = {r[0]: r for r in rows if r[0] != rows[7][0]} | {r[0]: (*r[:3], r[3] and r[3].lower(), *r[4:]) for r in moved}
    got = {r.id: r for r in new.rows(spark).collect()}
    assert got.keys() == want.keys() and all(got[i].price == want[i][4] and got[i].brand == want[i][3] for i in want)
    assert new.vectors.sum() == len(want)
    assert {r.id: r.price for r in index.rows(spark).collect()} == old  # the older snapshot stays
    queries = [{"query_id": f"q{r[0]}", "embedding": r[1]} for r in rows[:20]]
    q = spark.createDataFrame([tuple(x.values()) for x in queries], "query_id string, embedding array<float>")
    assert ranked(V.vector_search(q, LI.open_leaf_index(spark, index.root), 5, 0.3)) == plain(queries, list(want.values()), 5, 0.3)
    assert ranked(V.vector_search(q, LI.open_leaf_index(spark, index.root, 0), 5, 0.3)) == plain(queries, rows, 5, 0.3)
    assert LI.update_leaf_index(spark, new, None, spark.createDataFrame([("unknown",)], "id string")) is new


def test_a_leaf_that_outgrows_the_bound_is_split(spark, monkeypatch):
    monkeypatch.setattr(LI, "LEAF_VECTORS", 10)
    rows = clustered(40, 6, 4, 5)
    index = LI.build_leaf_index(spark.createDataFrame(rows, SCHEMA), leaves=4)
    assert index.bound == 40
    more = [(f"m{r[0]}", *r[1:]) for r in clustered(200, 6, 2, 5, 0.3)]
    new = LI.update_leaf_index(spark, index, spark.createDataFrame(more, SCHEMA))
    assert len(new.leaf) > 4 and len(set(new.leaf)) == len(new.leaf) == len(new.centre)
    assert new.vectors.sum() == 240 and new.vectors.max() < 120
    queries = [{"query_id": f"q{r[0]}", "embedding": r[1]} for r in more[:20]]
    q = spark.createDataFrame([tuple(x.values()) for x in queries], "query_id string, embedding array<float>")
    assert ranked(V.vector_search(q, new, 6, 0.1)) == plain(queries, rows + more, 6, 0.1)


def test_empty_indexes(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    empty = LI.build_leaf_index(none)
    assert V.vector_search(q, empty, 3, 0.2).collect() == [] and empty.rows(spark).collect() == []
    assert LI.open_leaf_index(spark, empty.root).vectors.sum() == 0
    first = LI.update_leaf_index(spark, empty, spark.createDataFrame([("a", [1.0, 0.0], None, None, 1.0, 1.0)], SCHEMA))
    assert ranked(V.vector_search(q, first, 3, 0.2)) == {"q": ["a"]}
    last = LI.update_leaf_index(spark, first, None, first.rows(spark).select("id"))
    assert V.vector_search(q, last, 3, 0.2).collect() == [] and last.rows(spark).collect() == []
    again = LI.update_leaf_index(spark, last, spark.createDataFrame([("b", [0.5, 0.0], None, None, 1.0, 1.0)], SCHEMA))
    assert ranked(V.vector_search(q, again, 3, 0.2)) == {"q": ["b"]}
