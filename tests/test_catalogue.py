"""Catalogue, merchandising, orders and import on hand-made rows."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradewind.functions import arrays as AR, catalog as C, text as X
from tradewind.operators import catalog as K, importing as I, merchandising as M, orders as O
from tradewind.plans.product_import import categories_of, run_import
from tradewind.sources.product_files import numbered_lines, read_product_file

CATS = [("r", "Shop", "Shop", None, True), ("e", "Electronics", "Shop >> Electronics", "r", True),
        ("l", "Laptops", "Shop >> Electronics >> Laptops", "e", True),
        ("x", "Hidden", "Shop >> Electronics >> Hidden", "e", False),
        ("u", "A_B", "Shop >> A_B", "r", True), ("v", "AxB", "Shop >> AxB", "r", True),
        ("w", "Low", "Shop >> A_B >> Low", "u", True), ("z", "Low (AxB)", "Shop >> AxB >> Low", "v", True)]
PRODUCT = ("id string, name string, brand string, price decimal(10,2), rating decimal(2,1), review_count int, "
           "status string, featured boolean, stock_quantity int, category_id string")


def categories(spark):
    return spark.createDataFrame(CATS, "id string, name string, path string, parent_id string, active boolean")


def product(i, price="10", rating="4.0", status="ACTIVE", featured=False, stock=5, cat="l", brand="B", reviews=1):
    return (i, f"n{i}", brand, None if price is None else Decimal(price), None if rating is None else Decimal(rating),
            reviews, status, featured, stock, cat)


def test_descendants_are_literal_and_active(spark):
    got = {(r.ancestor_id, r.id) for r in K.descendants(categories(spark)).collect()}
    assert {i for a, i in got if a == "e"} == {"e", "l"}
    assert {i for a, i in got if a == "u"} == {"u", "w"}  # `_` in a name is no wildcard
    assert ("x", "x") in got


def test_rollup_counts_skip_inactive_branches(spark):
    p = spark.createDataFrame([product("1", cat="l"), product("2", cat="x"), product("3", cat="e"),
                               product("4", cat="l", status="DISCONTINUED")], PRODUCT)
    got = {r.id: r.product_count for r in K.rollup_counts(categories(spark), p).collect()}
    assert got["e"] == 2 and got["r"] == 2 and got["x"] == 1 and got["l"] == 1 and got["u"] == 0
    tree = K.category_tree(categories(spark), p).collect()
    assert [(c.name, c.product_count) for c in tree[0].children] == [("A_B", 0), ("AxB", 0), ("Electronics", 2)]


def test_filters_drop_nulls_only_when_set(spark):
    p = spark.createDataFrame([product("1", "5"), product("2", None), product("3", "7", None)], PRODUCT)
    assert K.Filters().apply(p).count() == 3
    assert [r.id for r in K.Filters(min_price=5).apply(p).orderBy("id").collect()] == ["1", "3"]
    assert K.Filters(min_rating=1).apply(p).count() == 2
    with pytest.raises(ValueError):
        K.products_by_price_range(p, 9, 3)


def test_trending_takes_categories_in_turn(spark):
    rows = [product(str(i), featured=i < 3, rating=str(5 - i * 0.1)[:3], cat="l") for i in range(5)]
    p = spark.createDataFrame(rows, PRODUCT).withColumn(
        "category_name", F.when(F.col("id").isin("0", "1", "3"), "A").when(F.col("id") == "2", "B"))
    assert [r.id for r in M.trending(p, 4).orderBy("rank").collect()] == ["0", "2", "4", "1"]


def test_best_of_alternates_bands_and_pages(spark):
    prices = ["4999.99", "5000", "30000", "30000.01", "100", "20000"]
    p = spark.createDataFrame([product(str(i), x) for i, x in enumerate(prices)], PRODUCT)
    pages = [M.best_of(p, categories(spark), ["ELECTRONICS"], M.ELECTRONICS_BANDS, n, 4, seed=1).orderBy("rank").collect()
             for n in (0, 1, 2)]
    assert [r.band for page in pages for r in page] == [0, 1, 2, 0, 2, 0]
    assert sorted(r.id for page in pages for r in page) == list("012345") and pages[2] == []


def test_synonyms_brand_reason_and_cuts(spark):
    df = spark.createDataFrame([("Smart Watches", "Pixel vs iPhone", "x" * 50)], "c string, q string, t string")
    r = df.select(X.category_synonyms(F.col("c")).alias("s"), X.extract_brand(F.col("q")).alias("b"),
                  X.cut_within(F.col("t"), 40).alias("w"), X.cut_after(F.col("t"), 40).alias("a"),
                  X.suggestion_reason(F.lit("trending"), F.lit("z")).alias("r")).first()
    assert r.s.startswith("fitness tracker") and r.b == "Apple" and len(r.w) == 40 and len(r.a) == 43
    assert r.r == "Trending now"


def test_description_is_cut_at_scripts_only_behind_text(spark):
    rows = [("good var x", "long"), ("var x", "long"), ("a P.when(b", "long"), ("  ", "long"), (None, "long")]
    df = spark.createDataFrame(rows, "s string, l string").select(X.clean_description(F.col("s"), F.col("l")).alias("d"))
    assert [r.d for r in df.collect()] == ["good", "var x", "a", "long", "long"]


def test_parsers_and_money(spark):
    df = spark.createDataFrame([("aed", "mens", "UNAVAILABLE"), ("xx", None, None)], "c string, g string, s string")
    got = df.select(C.parse_currency(F.col("c")), C.parse_gender(F.col("g")), C.parse_stock_status(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("AED", "MEN", "OUT_OF_STOCK"), ("INR", None, "ACTIVE")]
    m = spark.sql("select cast('2.345' as decimal(18,4)) a, cast('2.0' as decimal(18,4)) b")
    assert tuple(m.select(C.money(F.col("a")), C.compare_at_price(F.col("a"), F.col("b")),
                          C.compare_at_price(F.col("b"), F.col("b"))).first()) == (Decimal("2.35"), Decimal("2.35"), None)


def test_category_names_become_unique_in_order_of_use(spark):
    paths = [(0, "A >> Shoes"), (1, "B >> Shoes"), (2, "Shoes"), (3, "C >> Shoes (B)"), (4, "A >> Shoes")]
    got = {r.path: r.name for r in I.build_categories(spark.createDataFrame(paths, "line int, path string")).collect()}
    assert got["A >> Shoes"] == "Shoes" and got["B >> Shoes"] == "Shoes (B)"
    assert got["Shoes"].startswith("Shoes #")
    assert got["C >> Shoes (B)"] == "Shoes (B) (C)"  # the name was given away before
    assert len(got) == 7


def test_import_outcomes(spark, tmp_path):
    ok = lambda i, **kw: json.dumps({"uniq_id": i, "product_name": f" name {i} ", "selling_price": 10, "list_price": 10,
                                     "primary_category_name": "A", "sub_category_name": ["B", " "], "product_rank": 50, **kw})
    lines = [ok("1"), "", ok("2", selling_price=0), "{broken", ok("1"), ok("3", extra=1), ok(" 4 ", star_ratings=4.25)]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    known = spark.createDataFrame([("3",)], "sku string")
    df = run_import(spark, str(tmp_path / "f.txt"), known)
    assert {r.line_no: r.outcome for r in df.collect()} == {
        0: "imported", 2: "skipped", 3: "errors", 4: "skipped", 5: "skipped", 6: "imported"}
    r = {x.sku: x for x in df.filter("outcome = 'imported'").collect()}
    assert r["4"].rating == Decimal("4.3") and r["1"].compare_at_price is None and r["1"].featured
    assert Decimal("3.5") <= r["1"].rating <= Decimal("5.0") and r["1"].name == "name 1"
    assert [c.path for c in categories_of(df).orderBy("level").collect()] == ["A", "A >> B"]
    part = read_product_file(spark, str(tmp_path / "f.txt"), offset=1, limit=3)  # the blank line counts
    assert sorted(r.line_no for r in part.collect()) == [2, 3]


def test_lines_are_numbered_over_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}-{i}\n" for i in range(5)))
    got = [r.value for r in numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [f"{f}-{i}" for f in range(3) for i in range(5)]


def test_prices_shipping_and_tax(spark):
    carts = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u")], "id string, user_id string")
    lines = spark.createDataFrame([("a", "p", 2, Decimal("25.00")), ("b", "p", 1, Decimal("49.99"))],
                                  "cart_id string, product_id string, quantity int, unit_price decimal(10,2)")
    got = {r.id: (r.shipping, r.tax, r.total) for r in O.price_orders(carts, lines).collect()}
    assert got == {"a": (Decimal("0.00"), Decimal("4.00"), Decimal("54.00")),
                   "b": (Decimal("5.99"), Decimal("4.00"), Decimal("59.98"))}
    empty = {r.id: r.total_items for r in O.cart_summary(carts, lines).collect()}
    assert empty["c"] == 0


def test_stock_deltas_and_states(spark, monkeypatch):
    p = spark.createDataFrame([product("1", stock=5), product("2", stock=0, status="OUT_OF_STOCK"),
                               product("3", stock=2), product("4", stock=2, status="DISCONTINUED"), product("5"),
                               product("6", stock=5)], PRODUCT)
    d = spark.createDataFrame([("1", -5, 1), ("2", 3, 1), ("3", -3, 1), ("3", 4, 2), ("4", -2, 1), ("4", 2, 12), ("6", -8, 1),
                               ("6", 2, 2), ("6", -7, 3), ("6", -1, 4), ("6", None, 5), ("9", 4, 1)], "product_id string, delta int, t int")
    for block in (10 ** 6, 3, 1):
        monkeypatch.setattr(O, "STEP_BLOCK", block)
        got = {r.id: (r.new_quantity, r.new_status, r.went_negative, r.refused) for r in O.apply_stock_deltas(p, d, ["t"]).collect()}
        assert got == {"1": (0, "OUT_OF_STOCK", False, 0), "2": (3, "ACTIVE", False, 0), "3": (6, "ACTIVE", True, 1),
                       "4": (2, "ACTIVE", False, 0), "5": (5, "ACTIVE", False, 0), "6": (0, "OUT_OF_STOCK", True, 2)}


def test_names_taken_by_displaced_categories_displace_others(spark):
    paths = ["A >> X", "B >> X", "C >> X (B)", "D >> X (B) (C)", "E >> Y", "X (B) (C) (D)", "A"]
    got = {r.path: r.name for r in I.build_categories(spark.createDataFrame(list(enumerate(paths)), "line int, path string")).collect()}
    used, want = set(), {}
    for path in paths:
        parts = path.split(" >> ")
        for depth in range(len(parts)):
            node, raw = " >> ".join(parts[:depth + 1]), parts[depth]
            if node not in want:
                want[node] = raw if raw not in used else f"{raw} ({parts[depth - 1]})" if depth else got[node]
                used.add(want[node])
    assert got == want
    assert got["D >> X (B) (C)"] == "X (B) (C) (D)" and got["X (B) (C) (D)"].startswith("X (B) (C) (D) #")


def test_open_ranges_and_pools(spark):
    p = spark.createDataFrame([product(str(i), str(10 ** i), rating="4.0", cat="l") for i in range(8)], PRODUCT)
    assert K.products_by_price_range(p, 5, None).count() == 7 and K.products_by_price_range(p, 5).count() == 5
    assert K.products_by_price_range(p, None, None).count() == 8
    many = spark.createDataFrame([product(f"{i:03}", str(i), cat="l") for i in range(230)], PRODUCT)
    page = lambda n, pool: M.best_of(many, categories(spark), ["ELECTRONICS"], (10, 20), n, 20, 1, pool)
    assert page(10, -1).count() == 0 and page(10, None).count() == 20 and page(11, None).count() == 10
    seen = [r.id for n in range(12) for r in page(n, None).collect()]
    assert len(seen) == len(set(seen)) == 230


def test_payment_confirms_only_pending_orders(spark):
    o = spark.createDataFrame([("1", "PENDING"), ("2", "PENDING"), ("3", "SHIPPED"), ("4", "PENDING")], "id string, status string")
    ch = spark.createDataFrame([("1", 1, "PAYMENT", "PAID"), ("2", 1, "PAYMENT", "FAILED"), ("3", 1, "PAYMENT", "PAID"),
                                ("4", 1, "PAYMENT", "PAID"), ("4", 2, "STATUS", "PENDING")],
                               "order_id string, changed_at int, kind string, value string")
    got = {r.id: (r.status, r.payment_status, r.cancellable) for r in O.order_states(o, ch).collect()}
    assert got == {"1": ("CONFIRMED", "PAID", True), "2": ("PENDING", "FAILED", True), "3": ("SHIPPED", "PAID", False),
                   "4": ("PENDING", "PAID", True)}


def test_paths(spark):
    df = spark.createDataFrame([("A >> B >> C",), (None,)], "p string").select(AR.ancestor_paths(F.col("p")).alias("a"))
    assert [r.a for r in df.collect()] == [["A", "A >> B", "A >> B >> C"], None]


def test_prefilter_keeps_every_key_and_little_else(spark):
    from tradewind.operators.catalog import missing_skus
    from tradewind.operators.prefilter import may_hold

    stored = spark.range(20_000).selectExpr("concat('s', id) AS sku", "id").unionByName(
        spark.createDataFrame([(None, -1)], "sku string, id long"))
    incoming = spark.range(19_900, 20_100).selectExpr("concat('s', id) AS sku")
    kept = may_hold(stored, incoming, "sku")
    ids = {r.id for r in kept.collect()}
    assert kept.columns == stored.columns and ids >= set(range(19_900, 20_000)) and len(ids) < 200
    assert may_hold(stored, incoming, "sku", 6).count() >= 100  # a full filter loses nothing
    assert may_hold(stored, incoming.limit(0), "sku").count() == 0
    plan = missing_skus(incoming, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "_set" in plan
    assert sorted(r.sku for r in missing_skus(incoming, stored).collect()) == sorted(f"s{i}" for i in range(20_000, 20_100))


def test_an_import_counts_its_outcomes_while_it_is_written(spark, tmp_path):
    from tradewind.operators.importing import import_stats, observed_import, observed_stats

    lines = ['{"uniq_id":"a","product_name":"A","selling_price":5}', '{"uniq_id":"a","product_name":"A","selling_price":5}',
             '{"uniq_id":"b","product_name":"B","selling_price":5}', '{"broken', '{"uniq_id":"c","product_name":"C","selling_price":7}']
    (tmp_path / "f.txt").write_text("\n".join(lines))
    known = spark.createDataFrame([("b",)], "sku string")
    rows = run_import(spark, str(tmp_path / "f.txt"), known)
    observed, counts = observed_import(rows)
    observed.write.format("noop").mode("overwrite").save()
    pairs = lambda df: sorted((r.outcome, r["rows"]) for r in df.collect())
    assert pairs(observed_stats(spark, counts)) == pairs(import_stats(rows)) == [("errors", 1), ("imported", 2), ("skipped", 2)]
