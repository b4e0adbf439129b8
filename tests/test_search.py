"""Keyword and hybrid search."""

import random
import re

import pytest

from tradewind.functions.terms import exploded_terms
from tradewind.operators import hybrid as H, search as S

PRODUCTS = [
    ("1", "Apple iPhone 15", "Smart phone with camera", "Apple", "Smartphones", 79999.0, 4.5, "ACTIVE"),
    ("2", "Galaxy S24", "Android phones by the maker", "Samsung", "Smartphones", 69999.0, 4.4, "ACTIVE"),
    ("3", "Running Shoes", "Light shoes for running", "Puma", "Running Shoes", 2999.0, None, "ACTIVE"),
    ("4", "Street Sneakers", "100% cotton laces", "Puma", "Sneakers", 3999.0, 4.0, "ACTIVE"),
    ("5", "Phone case", "case_blue", "Generic", "Accessories", 199.0, 3.0, "ACTIVE"),
    ("6", "Old phone", "phone", "Apple", "Smartphones", 999.0, 2.0, "DISCONTINUED"),
    ("7", "QLED TV", "Samsung television", "Samsung", "Televisions", 49999.0, 4.1, "ACTIVE"),
]
CATS = [(str(i), n, f"Shop >> {n}", "s", True) for i, n in enumerate(
    ["Smartphones", "Running Shoes", "Sneakers", "Accessories", "Televisions", "Laptops", "2 in 1 Laptops"])] + [
    ("s", "Shop", "Shop", None, True)]


@pytest.fixture(scope="module")
def products(spark):
    cats = {n: i for i, n, *_ in CATS}
    rows = [(*p, cats[p[4]], False) for p in PRODUCTS]
    return spark.createDataFrame(rows, "id string, name string, description string, brand string, category_name string, "
                                 "price double, rating double, status string, category_id string, featured boolean")


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame(CATS, "id string, name string, path string, parent_id string, active boolean")


def asked(spark, *queries):
    rows = [(str(i), *(q if isinstance(q, tuple) else (q, None, None, None))) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id string, query string, min_price double, max_price double, min_rating double")


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def test_words_are_stemmed_alike(spark):
    pairs = ["phones phone", "running run", "shoes shoe", "batteries battery", "classes class", "charged charging"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i int, t string")
    got = {}
    for r in exploded_terms(df, ["i"], "t").collect():
        got.setdefault(r.i, set()).add(r.term)
    assert all(len(v) == 1 for v in got.values()), got


def test_all_terms_must_match_and_names_weigh_more(spark, products):
    got = hits(S.product_search(asked(
        spark, "phones", "samsung phone", "the and", "phone zebra", ("phone", None, 70000.0, None)), products, 5))
    assert got["0"] == ["5", "1", "2"]  # name above description; inactive products never
    assert got["1"] == ["2"] and "2" not in got and "3" not in got and got["4"] == ["5", "2"]


def test_fallback_only_without_matches_and_with_wildcards(spark, products):
    got = hits(S.product_search(asked(spark, "hon", "100%", "e_b", "%", "g%y s2", "a", "_", "\\%"), products, 10))
    assert got["0"] == ["1", "2", "5"] and got["1"] == ["4"]
    assert got["2"] == ["5"] and got["3"] == ["1", "2", "3", "4", "5", "7"]
    assert got["4"] == ["2"] and got["6"] == ["1", "2", "3", "4", "5", "7"] and got["7"] == ["4"]


def test_substring_search_matches_a_plain_scan(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab c%") for _ in range(n))
    rows = [(str(i), text(8), text(30), text(3), "ACTIVE", 1.0, 1.0) for i in range(60)]
    p = spark.createDataFrame(rows, "id string, name string, description string, brand string, status string, price double, rating double")
    queries = [text(n) for n in (1, 2, 3, 4, 5) for _ in range(8)]
    want = set()
    for q, t in enumerate(queries):
        pattern = re.compile(".*" + "".join(".*" if c == "%" else re.escape(c) for c in t) + ".*", re.S)
        want |= {(str(q), r[0]) for r in rows if any(pattern.fullmatch(f) for f in r[1:4])}
    got = [(r.query_id, r.id) for r in S.like_matches(asked(spark, *queries), p).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_substring_requests_are_searched_once(spark, products, monkeypatch):
    search, seen = S._like_matches, []
    monkeypatch.setattr(S, "_like_matches", lambda q, p: seen.append(q.count()) or search(q, p))
    monkeypatch.setattr(S, "REQUEST_ROWS", 3)
    texts = {f"q{i}": "a" if i % 4 else "zzz" for i in range(20)}
    queries = spark.createDataFrame([(q, t, None, None, None) for q, t in texts.items()],
                                    "query_id string, query string, min_price double, max_price double, min_rating double")
    got = sorted((r.query_id, r.id) for r in S.like_matches(queries, products).collect())
    one = [r.id for r in search(queries.filter("query_id = 'q1'"), products).collect()]
    assert one and got == sorted((q, i) for q, t in texts.items() if t == "a" for i in one)
    assert seen == [2]


def test_substring_matches_come_in_short_lists_that_repeat(spark):
    """Queries of one request take the same few products in turn, so that result files pack; popular requests become several lists."""
    from itertools import groupby
    products = spark.range(600).selectExpr(
        "cast(id AS string) AS id", "'Red Lamp' AS name", "'' AS description", "'b' AS brand", "'ACTIVE' AS status",
        "cast(1 AS double) AS price", "cast(1 AS double) AS rating")
    asked = spark.range(5).selectExpr(
        "concat('q', id) AS query_id", "if(id < 4, 'red', 'blue') AS query", "cast(null AS double) AS min_price",
        "cast(null AS double) AS max_price", "cast(null AS double) AS min_rating")
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(c) for c in limits]
    try:  # joined as large tables are
        for c in limits:
            spark.conf.set(c, "-1")
        rows = [(r.query_id, r.id) for r in S.like_matches(asked, products).collect()]
    finally:
        for c, value in zip(limits, before):
            spark.conf.set(c, value)
    assert sorted(rows) == sorted((f"q{i}", str(j)) for i in range(4) for j in range(600))
    runs = [(q, tuple(i for _, i in g)) for q, g in groupby(rows, lambda r: r[0])]
    assert max(len(ids) for _, ids in runs) <= 256
    assert len({ids for _, ids in runs}) == len(runs) / 4  # each list of ids once for each query


def test_refused_bounds(spark):
    with pytest.raises(Exception, match="minimum price"):
        S.check_bounds(asked(spark, ("x", 5.0, 1.0, None))).collect()


def test_category_names(spark, categories):
    names = spark.createDataFrame([("Shop",), ("lapt",), ("TV",), ("Laptops",)], "requested string")
    got = {}
    for r in S.expand_category_names(names, categories).collect():
        got.setdefault(r.requested, set()).add(r.category_name)
    assert got["lapt"] == {"lapt", "Laptops", "2 in 1 Laptops"} and got["TV"] == {"TV"}
    assert got["Laptops"] == {"Laptops"} and len(got["Shop"]) == 8
    ids = {r.requested: r.category_id for r in S.category_id_by_name(names, categories).collect()}
    assert ids["Laptops"] == "6" and "TV" not in ids  # name order decides: `2 in 1 Laptops` comes first


def test_hybrid_rules(spark, products, categories):
    index = products.filter("status = 'ACTIVE'").selectExpr("id", "array(float(id), float(1), float(0)) AS embedding", "category_id", "brand", "price", "rating")
    rows = [("a", "running shoes", "Running Shoes", "Puma", None, None, None), ("b", "phone", "Smartphones", "Samsung", None, None, None),
            ("c", "samsung", None, None, None, None, None), ("d", "phone", None, None, None, 70000.0, None),
            ("e", None, None, "puma", None, None, 3.5), ("f", None, "Laptops", None, None, None, None),
            ("g", None, None, None, 2000.0, 4000.0, 4.0), ("h", "iphone", None, None, None, None, None)]
    q = spark.createDataFrame([(*r, [1.0, 0.0, 0.0]) for r in rows],
                              "query_id string, query string, category string, brand string, min_price double, max_price double, "
                              "min_rating double, embedding array<float>")
    got = hits(H.search_products(q, products, categories, index, 0.5))
    assert got["a"] == ["3", "4"]  # a brand admits related categories of the same domain
    assert got["b"] == ["2"]  # but phones never admit televisions
    assert set(got["c"]) == {"2", "7"}  # the brand is read from the text
    assert got["d"][:2] == ["2", "7"] and "1" not in got["d"]  # dearest first within the budget
    assert got["e"] == ["4"]  # a missing rating fails a bound that is set
    assert "f" not in got and got["g"] == ["4"] and got["h"] == ["1"]


def test_mode_of_category_and_event(spark, products):
    q = asked(spark, "phone", "nothing at all")
    results = H.hydrate(S.product_search(q, products, 5), products.select("id", "category_name"))
    events = {r.query: r for r in H.ai_events(q.selectExpr(
        "*", "cast(null as string) user_id", "'' session_id", "'t' tool_name", "cast(null as string) search_type", "' ' category"),
        results, "2024-01-01 00:00:00").collect()}
    assert events["phone"].category == "Smartphones" and events["phone"].returned_product_ids == ["5", "1", "2"]
    assert events["nothing at all"].category == "" and events["nothing at all"].results_count == 0
    assert events["phone"].user_id == "anonymous" and events["phone"].timestamp == "2024-01-01T00:00:00Z"


def test_first_in_bounds_against_sorting_everything(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    some = lambda *values: rng.choice([None, *values])
    rows = [(f"{i:03}", rng.choice(["hot"] * 5 + ["b", None]), some(*[rng.choice([5.0, 20.0, 20.0, rng.uniform(0, 90)]) for _ in range(6)]),
             some(*[rng.randrange(51) / 10 for _ in range(6)])) for i in range(400)]
    asked_rows = []
    for i in range(120):
        low, high = sorted((rng.uniform(0, 60), rng.uniform(0, 60)))
        asked_rows.append((str(i), rng.choice(["hot", "b", "c"]), some(low, 20.0 if high >= 20 else low), some(max(high, 20.0)),
                           some(rng.randrange(51) / 10)))
    monkeypatch.setattr(S, "PIECE_ROWS", 3)
    products = spark.createDataFrame(rows, "id string, g string, price double, rating double")
    queries = spark.createDataFrame(asked_rows, "query_id string, g string, min_price double, max_price double, min_rating double")
    got = {}
    for r in S.first_in_bounds(queries, products, ["g"], [F.col("price"), F.col("id")], 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    want = {}
    for q, g, low, high, stars in asked_rows:
        fits = [(-1 if p is None else p, i) for i, h, p, s in rows if h == g and (low is None or p is not None and p >= low)
                and (high is None or p is not None and p <= high) and (stars is None or s is not None and s >= stars)]
        if fits:
            want[q] = [i for _, i in sorted(fits)[:6]]
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


def test_bounds_do_not_join_requests_with_whole_groups(spark):
    """Rows that leave the joins of one hot group grow with the requests alone, not with requests times products."""
    from pyspark.sql import functions as F

    def joined_rows(n):
        products = spark.range(n).selectExpr("cast(id AS string) id", "'hot' AS g", "id % 5000 / 7.0 AS price", "id % 50 / 10.0 AS rating")
        queries = spark.range(200).selectExpr("cast(id AS string) query_id", "'hot' AS g", "50.0 + id AS min_price",
                                              "500.0 - id AS max_price", "cast(null AS double) min_rating")
        df = S.first_in_bounds(queries, products, ["g"], [F.col("price"), F.col("id")], 5)
        df.collect()
        plan, total = df._jdf.queryExecution().executedPlan(), 0
        stack = [plan]
        while stack:
            node = stack.pop()
            name = node.nodeName()
            if "AdaptiveSparkPlan" in name:
                stack.append(node.executedPlan())
                continue
            if "QueryStage" in name:
                stack.append(node.plan())
                continue
            if "Join" in name and node.metrics().contains("numOutputRows"):
                total += node.metrics().apply("numOutputRows").value()
            stack += [node.children().apply(i) for i in range(node.children().size())]
        return total

    few, many = joined_rows(5_000), joined_rows(50_000)
    assert few > 0 and many < 3 * few + 50_000  # each product is dealt to its piece once


def test_bounded_requests_meet_few_rows_each(spark):
    """A request around a price joins a few rows for each node of its ratings, not all cells inside its bounds."""
    from pyspark.sql import functions as F

    products = spark.range(6_000).selectExpr(
        "cast(id AS string) id", "'hot' AS g", "pow(2, id % 997 / 70.0) AS price", "id % 51 / 10.0 AS rating")

    def joined_rows(n):
        queries = spark.range(n).selectExpr("cast(id AS string) query_id", "'hot' AS g", "1.0 + id % 13 AS min_price",
                                            "9000.0 - id AS max_price", "id % 50 / 10.0 min_rating")
        df = S.first_in_bounds(queries, products, ["g"], [F.col("price"), F.col("id")], 5)
        assert df.count() == 5 * n
        df.collect()
        total, stack = 0, [df._jdf.queryExecution().executedPlan()]
        while stack:
            node = stack.pop()
            if "AdaptiveSparkPlan" in node.nodeName():
                stack.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                stack.append(node.plan())
            elif "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                total += node.metrics().apply("numOutputRows").value()
            stack += [node.children().apply(i) for i in range(node.children().size())]
        return total

    assert joined_rows(1_200) - joined_rows(200) < 20 * 1_000
