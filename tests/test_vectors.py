"""Vector search against plain loops."""

import numpy as np
import pandas as pd
import pytest

from tradewind.operators import vectors as V
from tradewind.sources import leaf_index as LI, product_files as PF, vector_store as VS

SCHEMA = "id string, embedding array<float>, category_id string, brand string, price double, rating double"


def data(n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"{i:03d}", [float(x) for x in rng.normal(size=dims)], f"c{i % 3}", "B" if i % 4 else None,
             float(i), None if i % 5 == 0 else float(i % 6)) for i in range(n)]
    rows[7] = (rows[7][0], rows[3][1], *rows[7][2:])  # equal vectors tie, the smaller id first
    rows[11] = (rows[11][0], [0.0] * dims, *rows[11][2:])  # a zero vector matches nothing
    return rows


def plain(queries, rows, k, threshold):
    out = {}
    for q in queries:
        a = np.asarray(q["embedding"], dtype=np.float32).astype(float)
        found = []
        for i, e, category, brand, price, rating in rows:
            b = np.asarray(e, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(a @ b / norm), 9) if norm else 0.0
            if s < threshold or (q.get("max_price") is not None and price > q["max_price"]):
                continue
            if q.get("min_rating") is not None and (rating is None or rating < q["min_rating"]):
                continue
            if q.get("category_id") is not None and category != q["category_id"]:
                continue
            found.append((-s, i))
        out[q["query_id"]] = [i for _, i in sorted(found)[:k]]
    return {k_: v for k_, v in out.items() if v}


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("leaves", [None, 1, 25])
@pytest.mark.parametrize("threshold", [0.5, 0.1, -1.0])
def test_exact_search(spark, leaves, threshold, monkeypatch):
    rows = data(120, 6, 1)
    queries = [{"query_id": f"q{i}", "embedding": r[1], "max_price": 60.0 if i % 2 else None,
                "min_rating": 2.0 if i % 3 == 0 else None, "category_id": "c1" if i % 5 == 0 else None}
               for i, r in enumerate(data(40, 6, 2))]
    q = spark.createDataFrame([tuple(x.values()) for x in queries],
                              "query_id string, embedding array<float>, max_price double, min_rating double, category_id string")
    index = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 10)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 15)
    monkeypatch.setattr(V, "MAX_PRODUCT", 500)
    got = ranked(V.vector_search(q, index, 7, threshold, leaves=leaves))
    assert got == plain(queries, rows, 7, threshold)


def test_leaf_share_trades_recall(spark):
    rows = data(300, 8, 4)
    index = spark.createDataFrame(rows, SCHEMA)
    q = index.selectExpr("id AS query_id", "embedding")
    exact = ranked(V.vector_search(q, index, 5, 0.3))
    near = ranked(V.vector_search(q, index, 5, 0.3, share=0.3, leaves=20))
    kept = sum(len(set(near.get(i, [])) & set(v)) for i, v in exact.items()) / sum(map(len, exact.values()))
    assert 0.5 < kept <= 1.0
    every = ranked(V.vector_search(q, index, 5, 0.3, share=1.0, leaves=20))
    assert every == exact


def test_threshold_is_inclusive_and_empty_queries(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0], None, None, 1.0, 1.0), ("b", [0.0, 1.0], None, None, 1.0, 1.0),
                                   ("c", [-1.0, 0.0], None, None, 1.0, 1.0), ("d", [0.5, 3 ** 0.5 / 2], None, None, 1.0, 1.0)], SCHEMA)
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.id for r in V.vector_search(q, index, 9, 0.5).orderBy("rank").collect()] == ["a", "d"]
    assert V.vector_search(q.limit(0), index, 9, 0.5).count() == 0


def test_missing_and_odd_vectors_are_in_no_result(spark):
    rows = [("a", [1.0, 0.0], None, None, 1.0, 1.0), ("b", None, None, None, 1.0, 1.0), ("c", [1.0], None, None, 1.0, 1.0),
            ("d", [1.0, None], None, None, 1.0, 1.0), ("e", [1.0, 0.1], None, None, None, None), ("f", [], None, None, 1.0, 1.0)]
    index = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None), ("s", [1.0, 2.0, 3.0])], "query_id string, embedding array<float>")
    assert ranked(V.vector_search(q, index, 9, 0.5)) == {"q": ["a", "e"]}
    for empty in (index.limit(0), index.filter("id = 'b'")):
        assert V.vector_search(q, empty, 9, 0.5).collect() == []
    assert V.unit_rows(index.limit(0).toPandas()["embedding"]).shape[0] == 0


def test_vectors_go_to_the_visits_of_their_own_leaf_alone(spark, monkeypatch):
    """A vector is sent once for each group of queries that visit its leaf, and not at all without one."""
    rows = [(f"{side}{i}", [side + i / 1000, 0.1 * side], None, None, 1.0, 1.0) for side in (1.0, -1.0) for i in range(30)]
    index = spark.createDataFrame(rows, SCHEMA)
    q = index.filter("id like '1.0%'").selectExpr("id AS query_id", "embedding")
    monkeypatch.setattr(V, "BLOCK_QUERIES", 10)
    match = V._block_matches
    seen = spark.sparkContext.accumulator(0)

    def counted(asked, matrix, vectors):
        seen.add(len(vectors))
        return match(asked, matrix, vectors)

    monkeypatch.setattr(V, "_block_matches", counted)
    found = V.vector_search(q, index, 3, 0.9, leaves=2).collect()
    assert len(found) == 90 and all(r.id.startswith("1.0") for r in found)
    assert seen.value <= 30 * 3  # thirty visits of one leaf are three groups; the other leaf stays where it is
    assert LI.leaf_count(10 ** 6, 64) == 977 and LI.leaf_count(10 ** 8, 64) == 10 ** 4 and LI.leaf_count(900, 64) == 1
    assert LI.leaf_count(10 ** 12, 1024) * 8 * 1024 <= LI.CENTRE_BYTES


def test_blocks_are_exact_and_meet_only_what_is_asked_for(monkeypatch):
    """Matches closer together than single precision tells apart, equal vectors, restricts and leaves that are not visited;
    queries for a brand are not multiplied with the vectors of other brands."""
    rng = np.random.default_rng(3)
    some = rng.normal(size=(250, 16))
    vectors = np.concatenate([some * (1 + 1e-8), some + 2e-7 * rng.normal(size=some.shape), some, rng.normal(size=(750, 16))]).astype(np.float32)
    n, m, k = len(vectors), 1600, rng.integers(1, 6, size=1600).astype(np.int32)
    v = pd.DataFrame({"id": [f"{i * 7919 % n:04d}" for i in range(n)], "embedding": list(vectors), "category_id": [f"c{i % 3}" for i in range(n)],
                      "brand": [None if i % 7 == 0 else f"b{i % 4}" for i in range(n)], "price": rng.random(n), "rating": rng.random(n),
                      "place": rng.integers(0, 5, size=n)})
    v.loc[5, "rating"] = None
    asked = np.concatenate([some, some, some, some, rng.normal(size=(m - 1000, 16))]).astype(np.float32)
    none = lambda x, keep: np.where(keep, x, None)
    i = np.arange(m)
    q = pd.DataFrame({"query_id": [f"q{j}" for j in i], "bound": np.where(i % 2, 0.3, -1.0), "k": k,
                      "min_price": none(0.3, i % 9 == 0), "max_price": none(0.8, i % 5 == 0), "min_rating": none(0.4, i % 8 == 1),
                      "category_id": none("c1", i % 50 == 0), "brand": none(np.array([f"b{j // 2 % 4}" for j in i], object), i < 1500)})
    q["visits"] = list(rng.random((m, 5)) < 0.7)
    products, multiply = [], V._product_matches
    monkeypatch.setattr(V, "_product_matches", lambda a, b, *more: products.append(len(a) * len(b)) or multiply(a, b, *more))
    monkeypatch.setattr(V, "CUT_QUERIES", 1000)
    found = V._block_matches(q, V.unit(asked), v).groupby("query_id")
    got = {x: list(zip(r.sort_values(["similarity", "id"], ascending=[False, True]).id, r.similarity.sort_values(ascending=False))) for x, r in found}
    sims = np.round(V.unit(asked) @ V.unit(vectors).T, 9)
    want = {}
    for j, r in enumerate(q.itertuples()):
        ok = (sims[j] >= r.bound) & r.visits[v.place]
        for bound, test in ((r.min_price, lambda x: v.price >= x), (r.max_price, lambda x: v.price <= x), (r.min_rating, lambda x: v.rating >= x),
                            (r.category_id, lambda x: v.category_id == x), (r.brand, lambda x: v.brand == x)):
            if bound is not None and bound == bound:
                ok &= test(bound).to_numpy()
        rows = sorted((-sims[j, a], v.id[a]) for a in np.flatnonzero(ok))[:r.k]
        if rows:
            want[r.query_id] = [(a, -s) for s, a in rows]
    assert got.keys() == want.keys()
    assert all([a for a, _ in got[x]] == [a for a, _ in want[x]] and np.allclose([s for _, s in got[x]], [s for _, s in want[x]], atol=2e-9) for x in want)
    assert sum(products) < 0.5 * 0.7 * n * m  # 1,500 of the 1,600 queries ask for one of four brands


def test_a_query_goes_once_to_the_leaves_of_a_bin(spark, monkeypatch):
    """Leaves of one bin are searched together: vectors and queries are not sent again for every leaf."""
    rows = data(400, 6, 7)
    index = spark.createDataFrame(rows, SCHEMA)
    q = index.selectExpr("id AS query_id", "embedding")
    exact = ranked(V.vector_search(q, index, 4, -1.0, leaves=1))
    match, calls, found = V._block_matches, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(asked, matrix, vectors):
        calls.add(len(asked))
        got = match(asked, matrix, vectors)
        found.add(len(got))
        return got

    monkeypatch.setattr(V, "_block_matches", counted)
    assert ranked(V.vector_search(q, index, 4, -1.0, leaves=16)) == exact
    assert calls.value <= 2 * 400 and found.value <= 2 * 4 * 400  # two passes


def test_index_merge_and_files(spark, tmp_path):
    old = spark.createDataFrame([("a", [1.0], "c", "x", 1.0, None), ("b", [2.0], "c", None, 2.0, 3.0)], SCHEMA)
    new = spark.createDataFrame([("b", [5.0], "d", "y", 2.5, 4.0)], SCHEMA)
    first = VS.write_index(spark, old, None)
    rows = {r.id: r.embedding for r in spark.read.parquet(VS.write_index(spark, new, first)).collect()}
    assert rows == {"a": [1.0], "b": [5.0]}
    assert [r.id for r in spark.read.parquet(VS.write_index(spark, new, first, complete_overwrite=True)).collect()] == ["b"]
    points = {r.id: r.datapoint for r in VS.datapoints(old).collect()}
    assert '"brand"' in points["a"] and '"rating"' not in points["a"] and '"brand"' not in points["b"]
    (tmp_path / "p.jsonl").write_text('{"instance":{"id":"a"},"predictions":[{"embeddings":{"values":[0.5,1]}}]}\n'
                                      '{"instance":{"id":"b"},"predictions":[]}\n')
    assert [(r.id, r.embedding) for r in PF.read_embeddings(spark, str(tmp_path)).collect()] == [("a", [0.5, 1.0])]


def test_variant_limits(spark):
    rows = data(60, 4, 9)
    index = spark.createDataFrame(rows, SCHEMA)
    variants = spark.createDataFrame([("q", 0, rows[0][1]), ("q", 1, rows[1][1]), ("r", 0, rows[2][1])],
                                     "query_id string, variant int, embedding array<float>")
    got = ranked(V.expanded_search(variants, index, 6, 0.0))
    each = plain([{"query_id": str(i), "embedding": rows[i][1]} for i in (0, 1)], rows, 4, 0.0)  # max(3, 6/2 + 1)
    assert set(got["q"]) == set((each["0"] + each["1"])) or len(got["q"]) == 6
    assert got["r"] == plain([{"query_id": "r", "embedding": rows[2][1]}], rows, 6, 0.0)["r"]
