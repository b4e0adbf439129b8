"""Queries over the catalogue, merchandising lists, orders, carts and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A, catalog as C, text as X
from ..operators import catalog as K, importing, merchandising as M, orders as O, ranking as R
from ..plans.product_import import run_import
from ..session import fresh_path, materialise
from ..sources import product_files as PF
from .registry import flat, query, r
from .shapes import Shapes

ACTIVE = "status = 'ACTIVE'"
BUDGETED = K.Filters(min_price=2000, max_price=30000, min_rating=2.5)
BUDGETED_SQL = "price >= 2000 AND price <= 30000 AND rating >= 2.5"
ROOT = "md5('Catalog')"
LARGE = "md5('Catalog >> LARGE')"
LARGE_GEAR = "md5('Catalog >> LARGE >> gear')"


def md5(text: str) -> str:
    import hashlib
    return hashlib.md5(text.encode()).hexdigest()


@query("p3_active_products", f"SELECT id, name, {r('price')} FROM x_prod WHERE {ACTIVE}")
def p3(s: Shapes) -> DataFrame:
    return flat(K.active_products(s.products()).select("id", "name", F.col("price").cast("double").alias("price")))


@query("p4_products_by_ids", "SELECT id, sku FROM x_prod WHERE id IN (SELECT product_id FROM x_views)")
def p4(s: Shapes) -> DataFrame:
    return K.products_by_ids(s.products(), s.product_views().select(F.col("product_id").alias("id"))).select("id", "sku")


@query("p4_products_by_ids_stored", "SELECT id, sku FROM x_prod WHERE id IN (SELECT product_id FROM x_views)")
def p4_stored(s: Shapes) -> DataFrame:
    """The same from the keyed table, of which only the buckets of the ids are read."""
    return s.product_store().lookup(s.product_views().select(F.col("product_id").alias("id"))).select("id", "sku")


@query("p4_product_by_id_and_sku", "SELECT id, sku FROM x_prod WHERE id = '7' OR sku = 'SKU-11'")
def p4_one(s: Shapes) -> DataFrame:
    return K.product_by_id(s.products(), "7").unionByName(K.product_by_sku(s.products(), "SKU-11")).select("id", "sku")


@query("p5_products_by_category_direct",
       f"SELECT id, name FROM x_prod WHERE {ACTIVE} AND category_id = {LARGE_GEAR} AND {BUDGETED_SQL}")
def p5(s: Shapes) -> DataFrame:
    return K.products_by_category_direct(s.products(), md5("Catalog >> LARGE >> gear"), BUDGETED).select("id", "name")


@query("p6_products_by_brand", "SELECT id, status FROM x_prod WHERE brand = 'Brand#7'")
def p6(s: Shapes) -> DataFrame:
    return K.products_by_brand(s.products(), "Brand#7").select("id", "status")


@query("p7_products_by_brand_filtered",
       f"SELECT id, {r('price')} FROM x_prod WHERE {ACTIVE} AND lower(brand) = 'brand#7' AND {BUDGETED_SQL}")
def p7(s: Shapes) -> DataFrame:
    return flat(K.products_by_brand_filtered(s.products(), "BRAND#7", BUDGETED).select(
        "id", F.col("price").cast("double").alias("price")))


@query("p8_products_by_price_range", f"SELECT id FROM x_prod WHERE {ACTIVE} AND price BETWEEN 0 AND 5000")
def p8(s: Shapes) -> DataFrame:
    return K.products_by_price_range(s.products(), high=5000).select("id")


@query("p8_no_bounds", f"SELECT id, {r('price * 1000', 'price')} FROM x_prod WHERE {ACTIVE} AND price IS NOT NULL")
def p8_open(s: Shapes) -> DataFrame:
    """Without bounds no product is too dear; prices here go beyond the default ceiling."""
    dear = s.products().withColumn("price", F.col("price").cast("double") * 1000)
    return flat(K.products_by_price_range(dear, None, None).select("id", "price"))


@query("p9_featured_products", f"SELECT id FROM x_prod WHERE {ACTIVE} AND featured")
def p9(s: Shapes) -> DataFrame:
    return K.featured_products(s.products()).select("id")


@query("p10_in_stock", f"SELECT id, CASE WHEN stock_quantity > 0 AND {ACTIVE} THEN 1 ELSE 0 END AS in_stock FROM x_prod")
def p10(s: Shapes) -> DataFrame:
    return s.products().select("id", K.in_stock().cast("int").alias("in_stock"))


@query("p11_orders_by", """
SELECT 'date' AS how, id FROM x_ord WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'
UNION ALL SELECT 'user', id FROM x_ord WHERE user_id = '42'
UNION ALL SELECT 'status', id FROM x_ord WHERE status = 'PENDING'
UNION ALL SELECT 'both', id FROM x_ord WHERE user_id = '42' AND status = 'DELIVERED'
UNION ALL SELECT 'number', id FROM x_ord WHERE order_number = 'ORD-77'""")
def p11(s: Shapes) -> DataFrame:
    o = s.orders()
    parts = {"date": O.orders_by(o, start="1996-01-01", end="1996-06-30"), "user": O.orders_by(o, user_id="42"),
             "status": O.orders_by(o, status="PENDING"), "both": O.orders_by(o, user_id="42", status="DELIVERED"),
             "number": O.orders_by(o, order_number="ORD-77")}
    out = None
    for how, df in parts.items():
        part = df.select(F.lit(how).alias("how"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("p12_order_summary", f"""
SELECT o.id, o.status, {r('any_value(total_amount)', 'total_amount')}, count(l.order_id) AS line_count,
  coalesce(CAST(sum(quantity) AS BIGINT), 0) AS total_items, {r('coalesce(sum(subtotal), 0)', 'lines_amount')}
FROM x_ord o LEFT JOIN x_lines l ON l.order_id = o.id GROUP BY o.id, o.status""")
def p12(s: Shapes) -> DataFrame:
    df = O.order_summary(s.orders(), s.order_lines())
    return flat(df.select("id", "status", F.col("total_amount").cast("double").alias("total_amount"), "line_count",
                          "total_items", F.col("lines_amount").cast("double").alias("lines_amount")))


CART_SQL = """
SELECT c.id, c.user_id, count(l.cart_id) AS line_count, coalesce(CAST(sum(quantity) AS BIGINT), 0) AS total_items,
  coalesce(sum(unit_price * quantity), 0) AS amount FROM x_cart c LEFT JOIN x_cartline l ON l.cart_id = c.id GROUP BY ALL"""


@query("p12_cart_summary", f"SELECT id, user_id, line_count, total_items, {r('amount', 'total_amount')} FROM ({CART_SQL})")
def p12_cart(s: Shapes) -> DataFrame:
    df = O.cart_summary(s.carts(), s.cart_lines())
    return flat(df.withColumn("total_amount", F.col("total_amount").cast("double")))


@query("p16_valid_preferences", """
SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey * 100.0 END AS lo,
  abs(c_acctbal) AS hi FROM customer) WHERE lo IS NULL OR lo <= hi""")
def p16(s: Shapes) -> DataFrame:
    prefs = s.t("customer").select(
        "c_custkey", F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey") * 100.0).alias("min_price"),
        F.abs("c_acctbal").alias("max_price"))
    return K.valid_preferences(prefs).select("c_custkey")


@query("p17_categories_by", f"""
SELECT 'active' AS how, id, name FROM x_cat
UNION ALL SELECT 'root', id, name FROM x_cat WHERE parent_id IS NULL
UNION ALL SELECT 'parent', id, name FROM x_cat WHERE parent_id = {LARGE}
UNION ALL SELECT 'level', id, name FROM x_cat WHERE level = 1
UNION ALL SELECT 'path', id, name FROM x_cat WHERE path = 'Catalog >> LARGE'
UNION ALL SELECT 'prefix', id, name FROM x_cat WHERE path LIKE 'Catalog >> LARGE%'
UNION ALL SELECT 'name', id, name FROM x_cat WHERE lower(name) = 'large'""")
def p17(s: Shapes) -> DataFrame:
    c = s.categories()
    parts = {"active": K.categories_by(c), "root": K.categories_by(c, root=True),
             "parent": K.categories_by(c, parent_id=md5("Catalog >> LARGE")), "level": K.categories_by(c, level=1),
             "path": K.categories_by(c, path="Catalog >> LARGE"),
             "prefix": K.categories_by(c, path_prefix="Catalog >> LARGE"),
             "name": K.categories_by(c, name="Large", ignore_case=True, active_only=False)}
    out = None
    for how, df in parts.items():
        part = df.select(F.lit(how).alias("how"), "id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("p18_lines_by_keys", """
SELECT order_id, line FROM x_lines WHERE product_id IN (SELECT id FROM x_prod WHERE featured)""")
def p18(s: Shapes) -> DataFrame:
    keys = s.products().filter("featured").select(F.col("id").alias("product_id"))
    return K.rows_by_keys(s.order_lines(), keys, "product_id").select("order_id", "line")


@query("p18_exists_by", """
SELECT sku, CASE WHEN sku IN (SELECT sku FROM x_prod WHERE status = 'ACTIVE') THEN 1 ELSE 0 END AS found
FROM (SELECT DISTINCT 'SKU-' || product_id AS sku FROM x_lines)""")
def p18_exists(s: Shapes) -> DataFrame:
    keys = s.order_lines().select(F.concat(F.lit("SKU-"), "product_id").alias("sku"))
    return K.exists_by(keys, K.active_products(s.products()), "sku").select("sku", F.col("found").cast("int").alias("found"))


# ---- joins ----

@query("j3_products_with_category", "SELECT id, category_name, category_path FROM x_pc")
def j3(s: Shapes) -> DataFrame:
    return K.with_category(s.products(), s.categories()).select("id", "category_name", "category_path")


@query("j4_category_descendants", """
SELECT a.id AS ancestor_id, d.id, d.name FROM x_cat a JOIN x_cat d ON d.path = a.path OR starts_with(d.path, a.path || ' >> ')""")
def j4(s: Shapes) -> DataFrame:
    return K.descendants(s.categories())


@query("j4_products_by_category", f"""
SELECT p.id, {r('coalesce(rating, -1)', 'rating')}, row_number() OVER (PARTITION BY rating ORDER BY p.id) AS place
FROM x_prod p JOIN x_cat c ON c.id = p.category_id WHERE {ACTIVE} AND starts_with(c.path, 'Catalog >> LARGE')""")
def j4_products(s: Shapes) -> DataFrame:
    from pyspark.sql import Window as W
    df = K.products_by_category(s.products(), s.categories(), md5("Catalog >> LARGE"))
    place = F.row_number().over(W.partitionBy("rating").orderBy("id"))
    return flat(df.select("id", F.coalesce(F.col("rating").cast("double"), F.lit(-1.0)).alias("rating"), place.alias("place")))


@query("j5_missing_skus", """
SELECT DISTINCT 'SKU-' || product_id AS sku FROM x_views
WHERE 'SKU-' || product_id NOT IN (SELECT sku FROM x_prod WHERE status = 'ACTIVE')""")
def j5(s: Shapes) -> DataFrame:
    incoming = s.product_views().select(F.concat(F.lit("SKU-"), "product_id").alias("sku")).distinct()
    return K.missing_skus(incoming, K.active_products(s.products()))


@query("j6_orders_with_lines", """
SELECT o.id, coalesce(product_id, '') AS product_id, coalesce(quantity, 0) AS quantity
FROM x_ord o LEFT JOIN x_lines l ON l.order_id = o.id""")
def j6(s: Shapes) -> DataFrame:
    df = O.with_lines(s.orders().select("id"), s.order_lines(), "order_id")
    return df.select("id", F.coalesce("product_id", F.lit("")).alias("product_id"),
                     F.coalesce("quantity", F.lit(0)).alias("quantity"))


@query("j7_carts_with_lines", """
SELECT c.user_id, coalesce(product_id, '') AS product_id, coalesce(quantity, 0) AS quantity
FROM x_cart c LEFT JOIN x_cartline l ON l.cart_id = c.id""")
def j7(s: Shapes) -> DataFrame:
    df = O.with_lines(s.carts(), s.cart_lines(), "cart_id")
    return df.select("user_id", F.coalesce("product_id", F.lit("")).alias("product_id"),
                     F.coalesce("quantity", F.lit(0)).alias("quantity"))


# ---- counts ----

@query("a6_distinct_brands", f"SELECT DISTINCT brand FROM x_prod WHERE {ACTIVE} AND brand IS NOT NULL")
def a6(s: Shapes) -> DataFrame:
    return K.distinct_brands(s.products())


@query("a8_count_by_category", f"SELECT category_id, count(*) AS product_count FROM x_prod WHERE {ACTIVE} GROUP BY category_id")
def a8(s: Shapes) -> DataFrame:
    return K.count_by_category(s.products())


@query("a9_count_one_category", f"SELECT count(*) AS product_count FROM x_prod WHERE {ACTIVE} AND category_id = {LARGE_GEAR}")
def a9(s: Shapes) -> DataFrame:
    return K.count_in_category(s.products(), md5("Catalog >> LARGE >> gear"))


@query("a9_order_count_by_user", "SELECT user_id, count(*) AS order_count FROM x_ord GROUP BY user_id")
def a9_orders(s: Shapes) -> DataFrame:
    return O.order_count_by_user(s.orders())


ROLLUP = f"""
SELECT a.id, a.name, a.parent_id, a.path, count(p.id) AS product_count FROM x_cat a
LEFT JOIN x_cat d ON d.path = a.path OR starts_with(d.path, a.path || ' >> ')
LEFT JOIN x_prod p ON p.category_id = d.id AND {ACTIVE} GROUP BY ALL"""


@query("a10_category_rollup", f"SELECT id, name, product_count FROM ({ROLLUP})")
def a10(s: Shapes) -> DataFrame:
    return K.rollup_counts(s.categories(), s.products())


@query("e4_category_tree", f"""
SELECT a.id, a.name, a.product_count, coalesce(string_agg(c.name || ':' || c.product_count, '|' ORDER BY c.name), '') AS children
FROM ({ROLLUP}) a LEFT JOIN ({ROLLUP}) c ON c.parent_id = a.id WHERE a.parent_id IS NULL
GROUP BY a.id, a.name, a.product_count""")
def e4(s: Shapes) -> DataFrame:
    shown = F.transform("children", lambda c: F.concat(c["name"], F.lit(":"), c["product_count"].cast("string")))
    return flat(K.category_tree(s.categories(), s.products()).select("id", "name", "product_count", shown.alias("children")))


@query("e2_build_categories", "SELECT id, name, path, level, coalesce(parent_id, '') AS parent_id FROM x_cat")
def e2(s: Shapes) -> DataFrame:
    return importing.build_categories(s.category_paths()).select(
        "id", "name", "path", "level", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


# ---- ranking ----

@query("l1_page", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM x_ord QUALIFY place BETWEEN 41 AND 60")
def l1(s: Shapes) -> DataFrame:
    from pyspark.sql import Window as W
    page = R.page(s.orders(), [F.col("created_at").desc(), F.col("id")], number=2, size=20)
    return page.select("id", (F.row_number().over(W.orderBy(F.col("created_at").desc(), "id")) + 40).alias("place"))


@query("l1_page_info", "SELECT count(*) AS total_elements, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages, 2 AS page, 20 AS size FROM x_ord")
def l1_info(s: Shapes) -> DataFrame:
    return R.page_info(s.orders(), 2, 20)


@query("l2_sort_nulls_last", f"""
SELECT id, row_number() OVER (PARTITION BY category_id ORDER BY rating DESC NULLS LAST, id) AS place FROM x_prod WHERE {ACTIVE} AND featured""")
def l2(s: Shapes) -> DataFrame:
    from pyspark.sql import Window as W
    return K.featured_products(s.products()).select("id", F.row_number().over(
        W.partitionBy("category_id").orderBy(F.col("rating").desc_nulls_last(), "id")).alias("place"))


@query("l3_budget_order", """
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ceiling > 0 THEN price END DESC NULLS LAST, place, id) AS rank
FROM (SELECT o.user_id AS query_id, p.id, p.price, row_number() OVER (PARTITION BY o.user_id ORDER BY p.id) AS place,
        CAST(o.user_id AS INT) % 2 AS ceiling
      FROM (SELECT DISTINCT user_id, product_id FROM x_ord JOIN x_lines ON order_id = x_ord.id) o JOIN x_prod p ON p.id = o.product_id)""")
def l3(s: Shapes) -> DataFrame:
    from pyspark.sql import Window as W
    bought = s.order_lines().join(s.orders().select(F.col("id").alias("order_id"), "user_id"), "order_id").select(
        F.col("user_id").alias("query_id"), F.col("product_id").alias("id")).distinct()
    rows = bought.join(s.products().select("id", "price"), "id")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).withColumn(
        "max_price", F.when(F.col("query_id").cast("int") % 2 == 1, F.lit(99999.0)))
    return R.budget_order(rows).select("query_id", "id", "rank")


@query("l4_top_k_per_query", """
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY total_amount DESC, id) AS rank FROM x_ord QUALIFY rank <= 3""")
def l4(s: Shapes) -> DataFrame:
    return R.top_k(s.orders(), ["user_id"], [F.col("total_amount").desc(), F.col("id")], 3).select("user_id", "id", "rank")


TWO_SOURCES = """
SELECT 0 AS source, user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY product_id) AS rank
  FROM (SELECT DISTINCT user_id, product_id FROM x_views)
UNION ALL SELECT 1, user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY product_id)
  FROM (SELECT DISTINCT user_id, product_id FROM x_carts)"""


def two_sources(s: Shapes) -> list[DataFrame]:
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("product_id"))
    return [df.select("user_id", "product_id").distinct().withColumn("rank", rank)
            for df in (s.product_views(), s.cart_events())]


@query("u1_ordered_union_dedupe", f"""
SELECT user_id, product_id, a.source AS source, row_number() OVER (PARTITION BY user_id ORDER BY a.source, a.rank, product_id) AS rank
FROM (SELECT user_id, product_id, min(struct_pack(source := source, rank := rank)) AS a FROM ({TWO_SOURCES}) GROUP BY ALL)""")
def u1(s: Shapes) -> DataFrame:
    return R.ordered_union(two_sources(s), ["user_id", "product_id"])


@query("u2_union_keep_best_score", f"SELECT user_id, product_id, max(rank) AS rank FROM ({TWO_SOURCES}) GROUP BY ALL")
def u2(s: Shapes) -> DataFrame:
    return R.best_score_union(two_sources(s), ["user_id", "product_id"], "rank")


@query("u3_exclude_seen", """
SELECT DISTINCT user_id, product_id FROM x_views v
WHERE NOT EXISTS (SELECT 1 FROM x_carts c WHERE c.user_id = v.user_id AND c.product_id = v.product_id)""")
def u3(s: Shapes) -> DataFrame:
    views, carts = two_sources(s)
    return R.exclude_seen(views, carts, ["user_id", "product_id"]).select("user_id", "product_id")


# ---- merchandising ----

TRENDING = f"""
SELECT id, category_name, pos, row_number() OVER (PARTITION BY category_name ORDER BY pos) AS turn,
  min(pos) OVER (PARTITION BY category_name) AS first FROM (
  SELECT id, category_name, row_number() OVER (ORDER BY featured DESC, rating DESC NULLS LAST, review_count DESC, id) AS pos
  FROM x_pc WHERE {ACTIVE} QUALIFY pos <= 100)"""


@query("w1_trending", f"SELECT id, category_name, row_number() OVER (ORDER BY turn, first) AS rank FROM ({TRENDING}) QUALIFY rank <= 20")
def w1(s: Shapes) -> DataFrame:
    return M.trending(s.catalog(), 20).select("id", "category_name", "rank")


def spread_sql(rows: str, order: str, within: str, pool: int | None, size: int) -> str:
    """SQL for a list spread over categories: `within` each in turn, categories by their first place in `order`."""
    cut = f"QUALIFY pos <= {pool}" if pool else ""
    return f"""
SELECT id, category_name, row_number() OVER (ORDER BY turn, first) AS rank FROM (
  SELECT id, category_name, row_number() OVER (PARTITION BY category_name ORDER BY {within}) AS turn,
    min(pos) OVER (PARTITION BY category_name) AS first
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM x_pc WHERE {rows} {cut})) QUALIFY rank <= {size}"""


@query("w1_trending_uncut", spread_sql(ACTIVE, "featured DESC, rating DESC NULLS LAST, review_count DESC, id", "pos", None, 300))
def w1_uncut(s: Shapes) -> DataFrame:
    return M.trending(s.catalog(), 300, pool=None).select("id", "category_name", "rank")


@query("w2_featured_diverse", spread_sql(f"{ACTIVE} AND featured", "id", "md5(id || ':7'), id", 50, 10))
def w2(s: Shapes) -> DataFrame:
    return M.featured_diverse(s.catalog(), 10, seed=7).select("id", "category_name", "rank")


@query("w2_featured_diverse_uncut", spread_sql(f"{ACTIVE} AND featured", "id", "md5(id || ':7'), id", None, 200))
def w2_uncut(s: Shapes) -> DataFrame:
    return M.featured_diverse(s.catalog(), 200, seed=7, pool=None).select("id", "category_name", "rank")


@query("w2_featured_candidates", f"""
SELECT category_name, least(count(*), 1) AS shown FROM (
  SELECT id, category_name FROM x_pc WHERE {ACTIVE} AND featured ORDER BY id LIMIT 50) GROUP BY category_name
QUALIFY row_number() OVER (ORDER BY min(id)) <= 10""")
def w2_set(s: Shapes) -> DataFrame:
    """The categories of the shuffled list do not depend on the shuffle."""
    return M.featured_diverse(s.catalog(), 10, seed=7).groupBy("category_name").agg(F.count("*").alias("shown"))


def best_of_sql(pool: int | None, low: int, high: int) -> str:
    cut = f"LIMIT {pool}" if pool else ""
    return f"""
SELECT id, band, row_number() OVER (ORDER BY turn, band) AS rank FROM (
  SELECT id, band, row_number() OVER (PARTITION BY band ORDER BY md5(id || ':7'), id) AS turn FROM (
    SELECT p.id, CASE WHEN price < 5000 THEN 2 WHEN price <= 30000 THEN 0 ELSE 1 END AS band
    FROM x_prod p JOIN x_cat c ON c.id = p.category_id
    WHERE {ACTIVE} AND (starts_with(c.path, 'Catalog >> LARGE') OR starts_with(c.path, 'Catalog >> SMALL'))
    ORDER BY rating DESC NULLS LAST, p.id {cut})) QUALIFY rank BETWEEN {low} AND {high}"""


@query("w3_best_of", best_of_sql(200, 21, 40))
def w3(s: Shapes) -> DataFrame:
    return M.best_of(s.products(), s.categories(), ["large", "small"], M.ELECTRONICS_BANDS, 1, 20, seed=7).select(
        "id", "band", "rank")


@query("w3_best_of_uncut", best_of_sql(None, 241, 260))
def w3_uncut(s: Shapes) -> DataFrame:
    """A page that lies behind the default pool."""
    return M.best_of(s.products(), s.categories(), ["large", "small"], M.ELECTRONICS_BANDS, 12, 20, seed=7, pool=None).select(
        "id", "band", "rank")


@query("w3_best_of_bands", f"""
SELECT band, count(*) AS rows FROM (
  SELECT CASE WHEN price < 5000 THEN 2 WHEN price <= 30000 THEN 0 ELSE 1 END AS band FROM (
    SELECT p.price FROM x_prod p JOIN x_cat c ON c.id = p.category_id
    WHERE {ACTIVE} AND (starts_with(c.path, 'Catalog >> LARGE') OR starts_with(c.path, 'Catalog >> SMALL'))
    ORDER BY rating DESC NULLS LAST, p.id LIMIT 200)) GROUP BY band""")
def w3_bands(s: Shapes) -> DataFrame:
    """All pages together hold the same products whatever the shuffle."""
    df = M.best_of(s.products(), s.categories(), ["large", "small"], M.ELECTRONICS_BANDS, 0, 200, seed=7)
    return df.groupBy("band").agg(F.count("*").alias("rows"))


@query("w4_top_rated_by_categories", f"""
SELECT id, row_number() OVER (ORDER BY rating DESC NULLS LAST, review_count DESC, id) AS place FROM x_pc
WHERE {ACTIVE} AND category_name IN ('gear', 'widget', 'ring') AND price >= 500 AND price <= 20000 QUALIFY place <= 15""")
def w4(s: Shapes) -> DataFrame:
    from pyspark.sql import Window as W
    df = M.top_rated_by_categories(s.catalog(), ["gear", "widget", "ring"], 500, 20000, 15)
    return df.select("id", F.row_number().over(W.orderBy(
        F.col("rating").desc_nulls_last(), F.col("review_count").desc(), "id")).alias("place"))


@query("w4_top_rated_per_category", f"""
SELECT category_name, id, row_number() OVER (PARTITION BY category_name ORDER BY rating DESC NULLS LAST, review_count DESC, id) AS rank
FROM x_pc WHERE {ACTIVE} QUALIFY rank <= 5""")
def w4_each(s: Shapes) -> DataFrame:
    return M.top_rated_per_category(s.catalog(), 5).select("category_name", "id", "rank")


# ---- scalar functions ----

@query("f1_embedding_text", """
SELECT id, 'Category: ' || category_name || '. ' || name || '. Brand: ' || brand || '. ' || description AS content FROM x_pc""")
def f1(s: Shapes) -> DataFrame:
    return s.catalog().select("id", X.embedding_text(
        F.col("name"), F.col("description"), F.col("brand"), F.col("category_name")).alias("content"))


@query("f1_embedding_text_long", """
SELECT doc_id, trim('Category: Laptops (notebooks, portable computers, ultrabooks). ' || source || '. Brand: ' || lang || '. ' ||
  CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END) AS content
FROM documents WHERE trim(text) <> ''""")
def f1_long(s: Shapes) -> DataFrame:
    docs = s.t("documents").filter(F.trim("text") != "")
    return docs.select("doc_id", X.embedding_text(
        F.col("source"), F.col("text"), F.col("lang"), F.lit("Laptops")).alias("content"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(key: str, values: list[str]) -> str:
    """SQL for the value whose place in the list is key modulo its length."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def nth_of(key: str, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


# a category name and the place of its rule; the last ones meet none, or two of which the first counts
SYNONYM_CASES = [
    ("SmartPhones & more", 0), ("mobiles", 0), ("Mobiles and", None), ("LED Television", 1), ("TVs", 1), ("Gaming LAPTOPS", 2),
    ("Earphone Cases", 3), ("headphones", 3), ("Tablets", 4), ("Cameras", 5), ("Watches (Smart)", 6), ("Watches", None),
    ("Mini Fridge", 7), ("Refrigerators", 7), ("Washing Machines", 8), ("Air Conditioners", 9), ("ACs", 9), ("Kurtis", 10),
    ("Kurtas", 10), ("Sarees", 11), ("Saris", 11), ("T-Shirts", 12), ("Tshirts", 12), ("Slim Jeans", 13), ("Sneakers", 14),
    ("Sports Shoes", 14), ("Laptop Camera", 2), ("Smartphone Watch", 0), ("Garden", None)]


@query("f2_category_synonyms", "SELECT p_partkey, " + case_of("p_partkey", [
    "" if rule is None else X.CATEGORY_SYNONYMS[rule][3] for _, rule in SYNONYM_CASES]) + " AS synonyms FROM part")
def f2(s: Shapes) -> DataFrame:
    return s.t("part").select("p_partkey", X.category_synonyms(nth_of(
        "p_partkey", [name for name, _ in SYNONYM_CASES])).alias("synonyms"))


@query("f3_rerank_text", """
SELECT doc_id, source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' by ' || lang END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '. Category: ' || source END
  || '. ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS content
FROM documents""")
def f3(s: Shapes) -> DataFrame:
    return s.t("documents").select("doc_id", X.rerank_text(
        F.col("source"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")), F.when(F.col("doc_id") % 3 != 0, F.col("source")),
        F.col("text")).alias("content"))


@query("f4_product_query_text", "SELECT id, trim(name || ' ' || category_name || ' ' || brand) AS content FROM x_pc")
def f4(s: Shapes) -> DataFrame:
    return s.catalog().select("id", X.product_query_text(
        F.col("name"), F.col("category_name"), F.col("brand")).alias("content"))


BRAND_CASES = [
    ("cheap SAMSUNG phone", "Samsung"), ("an apple", "Apple"), ("iPhone case", "Apple"), ("oneplus 12", "OnePlus"),
    ("google home", "Google"), ("cheap PIXEL and sony", "Google"), ("Sony tv", "Sony"), ("jbl box", "JBL"), ("Bose", "Bose"),
    ("my Boat", "boAt"), ("marshall amp", "Marshall"), ("NIKE shoes", "Nike"), ("iqoo neo", "iQOO"), ("plain shoes", ""),
    ("nike or samsung", "Samsung")]


@query("f5_extract_brand", "SELECT p_partkey, " + case_of("p_partkey", [b for _, b in BRAND_CASES]) + " AS brand FROM part")
def f5(s: Shapes) -> DataFrame:
    text = nth_of("p_partkey", [q for q, _ in BRAND_CASES])
    return s.t("part").select("p_partkey", F.coalesce(X.extract_brand(text), F.lit("")).alias("brand"))


@query("f6_truncate", """
SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS within_40,
  CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS after_30 FROM documents""")
def f6(s: Shapes) -> DataFrame:
    return s.t("documents").select("doc_id", X.cut_within(F.col("text"), 40).alias("within_40"),
                                   X.cut_after(F.col("text"), 30).alias("after_30"))


@query("f7_clean_description", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN md5(url) WHEN 1 THEN md5('Soft ' || url) WHEN 2 THEN md5('Soft ' || url)
  WHEN 3 THEN md5('var x = 1; ' || url) ELSE md5(CASE WHEN instr(html, 'var ') > 1 THEN trim(substr(html, 1, instr(html, 'var ') - 1)) ELSE html END) END AS cleaned
FROM pages""")
def f7(s: Shapes) -> DataFrame:
    """Blank short texts, both remnants, a remnant at the start, and whole pages."""
    kind, url = F.col("page_id") % 5, F.col("url")
    short = (F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit("Soft "), url, F.lit(" P.when('A').execute(var y)")))
             .when(kind == 2, F.concat(F.lit("Soft "), url, F.lit(" var y = P.when(1)")))
             .when(kind == 3, F.concat(F.lit("var x = 1; "), url)).otherwise(F.col("html")))
    return s.t("pages").select("page_id", F.md5(X.clean_description(short, url)).alias("cleaned"))


@query("f8_parse_fields", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'USD' WHEN c_nationkey % 3 = 1 THEN 'INR' ELSE 'AED' END AS currency,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'WOMEN' WHEN 'MACHINERY' THEN 'MEN' ELSE '' END AS gender,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'OUT_OF_STOCK' WHEN 'MACHINERY' THEN 'DISCONTINUED' ELSE 'ACTIVE' END AS status FROM customer""")
def f8(s: Shapes) -> DataFrame:
    n, m = F.col("c_nationkey") % 3, F.col("c_mktsegment")
    money = F.when(n == 0, " usd ").when(n == 1, "doubloons").otherwise("AED")
    sex = F.when(m == "HOUSEHOLD", " female").when(m == "MACHINERY", "Men's").otherwise("robots")
    stock = F.when(m == "HOUSEHOLD", "OutOfStock").when(m == "MACHINERY", " discontinued ").otherwise("")
    return s.t("customer").select(
        "c_custkey", C.parse_currency(money).alias("currency"),
        F.coalesce(C.parse_gender(sex), F.lit("")).alias("gender"), C.parse_stock_status(stock).alias("status"))


@query("f9_compare_at_price", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r('coalesce(CASE WHEN lp > pr THEN round(lp, 2) END, -1)', 'compare_at')} FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,4)) AS lp,
    CAST(l_quantity AS DECIMAL(18,4)) * 1000 AS pr FROM lineitem)""")
def f9(s: Shapes) -> DataFrame:
    lp, pr = F.col("l_extendedprice").cast("decimal(18,4)"), F.col("l_quantity").cast("decimal(18,4)") * 1000
    return flat(s.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(
        C.compare_at_price(lp, pr).cast("double"), F.lit(-1.0)).alias("compare_at")))


@query("f10_valid_product", "SELECT doc_id, CASE WHEN trim(text) <> '' AND n_chars > 0 THEN 1 ELSE 0 END AS valid FROM documents")
def f10(s: Shapes) -> DataFrame:
    return s.t("documents").select("doc_id", C.valid_product(
        F.col("source"), F.col("text"), F.col("n_chars")).cast("int").alias("valid"))


@query("f11_default_draws", """
SELECT count(*) AS rows, 1 AS ratings_ok, 1 AS reviews_ok, 1 AS stock_ok FROM part""")
def f11(s: Shapes) -> DataFrame:
    """Draws repeat for a key and stay inside their ranges."""
    key, none = F.col("p_partkey").cast("string"), F.lit(None)
    rating = C.default_rating(none.cast("decimal(4,1)"), key)
    reviews = C.default_reviews(none.cast("int"), rating, key)
    stock = C.default_stock(F.lit("ACTIVE"), key)
    low = F.floor(rating) * 20
    return s.t("part").select(rating.alias("r"), reviews.alias("v"), stock.alias("q"), low.alias("low")).agg(
        F.count("*").alias("rows"), F.bool_and(F.col("r").between(3.5, 5.0)).cast("int").alias("ratings_ok"),
        F.bool_and(F.col("v").between(F.col("low"), F.col("low") + 99)).cast("int").alias("reviews_ok"),
        F.bool_and(F.col("q").between(10, 500)).cast("int").alias("stock_ok"))


@query("f12_suggestion_reason", """
SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'Based on your search for ' || p_name WHEN 'SMALL' THEN 'Similar to ' || p_name
  WHEN 'PROMO' THEN 'Popular in ' || p_name WHEN 'MEDIUM' THEN 'Trending now' WHEN 'ECONOMY' THEN 'Based on your interests'
  ELSE 'Recommended for you' END AS reason FROM part""")
def f12(s: Shapes) -> DataFrame:
    t = F.col("p_type")
    strategy = (F.when(t == "LARGE", "ai_intent").when(t == "SMALL", "similar_products")
                .when(t.isin("PROMO", "ECONOMY"), "category_affinity").when(t == "MEDIUM", "trending").otherwise("other"))
    context = F.when(t == "ECONOMY", " ").otherwise(F.col("p_name"))
    return s.t("part").select("p_partkey", X.suggestion_reason(strategy, context).alias("reason"))


@query("f13_order_number", """
SELECT id, 'ORD-' || strftime(created_at, '%Y%m%d%H%M%S') || '-' AS head, 23 AS length FROM x_ord""")
def f13(s: Shapes) -> DataFrame:
    number = C.order_number(F.col("created_at"), F.col("id"))
    return s.orders().select("id", F.substring(number, 1, 19).alias("head"), F.length(number).alias("length"))


@query("f14_category_path", """
SELECT p_partkey, p_type || ' >> ' || substr(p_brand || repeat('x', 300), 1, 200) || ' >> ' || p_name AS path FROM part""")
def f14(s: Shapes) -> DataFrame:
    subs = F.array(F.lit(" "), F.concat("p_brand", F.repeat(F.lit("x"), 300)), F.lit(None), F.concat(F.lit("  "), "p_name"))
    return s.t("part").select("p_partkey", A.category_path(F.concat("p_type", F.lit("  ")), subs).alias("path"))


@query("f15_ancestor_paths", """
SELECT line, 'Catalog' AS path FROM x_path UNION ALL
SELECT line, split_part(path, ' >> ', 1) || ' >> ' || split_part(path, ' >> ', 2) FROM x_path UNION ALL SELECT line, path FROM x_path""")
def f15(s: Shapes) -> DataFrame:
    return s.category_paths().select("line", F.explode(A.ancestor_paths(F.col("path"))).alias("path"))


# ---- orders and carts ----

@query("o1_price_orders", f"""
SELECT id, user_id, {r('amount', 'subtotal')}, {r('CASE WHEN amount >= 50 THEN 0 ELSE 5.99 END', 'shipping')},
  {r('round(amount * 0.08, 2)', 'tax')}, {r('amount + CASE WHEN amount >= 50 THEN 0 ELSE 5.99 END + round(amount * 0.08, 2)', 'total')}
FROM ({CART_SQL}) WHERE line_count > 0""")
def o1(s: Shapes) -> DataFrame:
    df = O.price_orders(s.carts(), s.cart_lines())
    return flat(df.select("id", "user_id", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "shipping", "tax", "total")]))


@query("o2_check_stock", """
SELECT cart_id, CASE WHEN count(reason) = 0 THEN 1 ELSE 0 END AS orderable,
  coalesce(arg_min(reason, product_id) FILTER (reason IS NOT NULL), '') AS reason FROM (
  SELECT cart_id, product_id, min(CASE WHEN status <> 'ACTIVE' OR stock_quantity <= 0 THEN 'not available'
    WHEN stock_quantity < quantity THEN 'insufficient stock' END) AS reason
  FROM x_cartline l JOIN x_prod p ON p.id = l.product_id GROUP BY cart_id, product_id) GROUP BY cart_id""")
def o2(s: Shapes) -> DataFrame:
    df = O.check_stock(s.cart_lines(), s.products())
    return df.select("cart_id", F.col("orderable").cast("int").alias("orderable"),
                     F.coalesce("reason", F.lit("")).alias("reason"))


STEPS = """
SELECT l.product_id, CASE WHEN o.status = 'DELIVERED' THEN -quantity ELSE quantity END AS delta, row_number() OVER (
    PARTITION BY product_id ORDER BY created_at, order_id, line, quantity, subtotal) AS n
FROM x_lines l JOIN x_ord o ON o.id = l.order_id"""


@query("o3_apply_stock_deltas", f"""
SELECT * FROM (WITH RECURSIVE steps AS MATERIALIZED ({STEPS}),
walk(id, n, stock, status, refused) AS (
  SELECT id, CAST(0 AS BIGINT), CAST(stock_quantity AS BIGINT), status, 0 FROM x_prod
  UNION ALL SELECT w.id, s.n, CASE WHEN w.stock + s.delta < 0 THEN w.stock ELSE w.stock + s.delta END,
    CASE WHEN w.stock + s.delta < 0 THEN w.status WHEN w.stock + s.delta = 0 THEN 'OUT_OF_STOCK'
      WHEN w.status = 'OUT_OF_STOCK' THEN 'ACTIVE' ELSE w.status END,
    w.refused + CASE WHEN w.stock + s.delta < 0 THEN 1 ELSE 0 END
  FROM walk w JOIN steps s ON s.product_id = w.id AND s.n = w.n + 1)
SELECT id, arg_max(stock, n) AS new_quantity, arg_max(status, n) AS new_status, CAST(max(refused) AS BIGINT) AS refused,
  CASE WHEN max(refused) > 0 THEN 1 ELSE 0 END AS went_negative
FROM walk GROUP BY id)""")
def o3(s: Shapes) -> DataFrame:
    moved = s.order_lines().join(s.orders().select(F.col("id").alias("order_id"), "created_at", "status"), "order_id")
    deltas = moved.withColumn("delta", F.when(F.col("status") == "DELIVERED", -F.col("quantity")).otherwise(F.col("quantity")))
    df = O.apply_stock_deltas(s.products(), deltas, ["created_at", "order_id", "line", "quantity", "subtotal"])
    return df.select("id", "new_quantity", "new_status", "refused", F.col("went_negative").cast("int").alias("went_negative"))


# Two payments and up to two status changes for each order, at several places among each other.
CHANGES = """
SELECT id, unnest([1, 3]) AS step, 'PAYMENT' AS kind, unnest([CASE WHEN id % 2 = 0 THEN 'PAID' ELSE 'FAILED' END,
  CASE WHEN id % 3 = 0 THEN 'PAID' ELSE 'FAILED' END]) AS value FROM o
UNION ALL SELECT id, 2, 'STATUS', CASE WHEN id % 4 = 0 THEN 'PENDING' ELSE 'PROCESSING' END FROM o WHERE id % 5 < 3
UNION ALL SELECT id, 4, 'STATUS', CASE WHEN id % 7 = 0 THEN 'CANCELLED' ELSE 'PENDING' END FROM o WHERE id % 5 < 2"""


@query("o4_order_state", f"""
SELECT * FROM (WITH RECURSIVE o AS (SELECT CAST(id AS BIGINT) AS id, status FROM x_ord),
changes AS MATERIALIZED ({CHANGES}),
walk(id, step, status, payment) AS (
  SELECT id, 0, status, 'PENDING' FROM o
  UNION ALL SELECT w.id, w.step + 1, CASE WHEN c.kind = 'STATUS' THEN c.value WHEN c.value = 'PAID' AND w.status = 'PENDING' THEN 'CONFIRMED'
    ELSE w.status END, CASE WHEN c.kind = 'PAYMENT' THEN c.value ELSE w.payment END
  FROM walk w LEFT JOIN changes c ON c.id = w.id AND c.step = w.step + 1 WHERE w.step < 4)
SELECT CAST(id AS VARCHAR) AS id, status, payment AS payment_status, CASE WHEN status IN ('PENDING', 'CONFIRMED') THEN 1 ELSE 0 END AS cancellable
FROM walk WHERE step = 4)""")
def o4(s: Shapes) -> DataFrame:
    n = F.col("id").cast("bigint")
    paid = lambda d: F.when(n % d == 0, "PAID").otherwise("FAILED")
    change = lambda at, kind, value, cond: F.when(cond, F.struct(
        F.lit(at).alias("changed_at"), F.lit(kind).alias("kind"), value.alias("value")))
    changes = s.orders().select(F.col("id").alias("order_id"), F.explode(F.array_compact(F.array(
        change(1, "PAYMENT", paid(2), F.lit(True)), change(3, "PAYMENT", paid(3), F.lit(True)),
        change(2, "STATUS", F.when(n % 4 == 0, "PENDING").otherwise("PROCESSING"), n % 5 < 3),
        change(4, "STATUS", F.when(n % 7 == 0, "CANCELLED").otherwise("PENDING"), n % 5 < 2)))).alias("c")).select("order_id", "c.*")
    return O.order_states(s.orders(), changes).select(
        "id", "status", "payment_status", F.col("cancellable").cast("int").alias("cancellable"))


@query("o5_cart_lines", """
SELECT user_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM x_cartline JOIN x_cart ON x_cart.id = cart_id GROUP BY ALL""")
def o5(s: Shapes) -> DataFrame:
    adds = s.cart_lines().join(s.carts().withColumnRenamed("id", "cart_id"), "cart_id")
    return O.cart_lines(adds)


# ---- import ----

def product_file(s: Shapes) -> str:
    """The catalogue as a product file: one JSON line per part, a blank line and a broken line for some."""
    line = F.to_json(F.struct(
        F.concat(F.lit("U-"), F.col("p_partkey").cast("string")).alias("uniq_id"), F.col("p_name").alias("product_name"),
        F.concat("p_name", F.lit(" var x = 1;")).alias("short_description"), F.col("p_brand").alias("brand_name"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("selling_price"),
        (F.col("p_retailprice") * (F.col("p_size") % 2 + 1)).cast("decimal(18,4)").alias("list_price"),
        F.lit("inr").alias("currency"), F.array(F.lit("http://img/1"), F.lit("http://img/2")).alias("image_urls"),
        F.lit("Catalog").alias("primary_category_name"),
        F.array("p_type", F.element_at(F.split("p_name", " "), -1)).alias("sub_category_name"),
        F.lit("in_stock").alias("stock_status"), F.lit(4.25).cast("decimal(18,4)").alias("star_ratings"),
        F.lit(7).alias("reviews_count"), F.col("p_size").alias("product_rank"), F.lit("kid").alias("gender"),
        F.lit("unused").alias("market")))
    broken = F.when(F.col("p_size") == 13, F.concat(F.substring(line, F.lit(1), F.lit(40)), F.lit("")))
    repeat = F.when(F.col("p_size") == 7, line)
    lines = s.t("part").orderBy("p_partkey").select(F.explode(F.array(
        F.coalesce(broken, line), F.coalesce(repeat, F.lit("")))).alias("value"))
    path = fresh_path(s.spark, "product-file")
    lines.write.text(path)
    return path


@query("s3_read_product_file", """
SELECT 2 * p_partkey AS line_no, CASE WHEN p_size = 13 THEN 1 ELSE 0 END AS is_error,
  CASE WHEN p_size = 13 THEN '' ELSE p_name END AS product_name FROM part
UNION ALL SELECT 2 * p_partkey + 1, 0, p_name FROM part WHERE p_size = 7""")
def s3(s: Shapes) -> DataFrame:
    df = PF.read_product_file(s.spark, product_file(s))
    return df.select("line_no", F.col("is_error").cast("int").alias("is_error"),
                     F.coalesce("product_name", F.lit("")).alias("product_name"))


@query("e1_import_products", f"""
SELECT 'U-' || p_partkey AS sku, p_name AS name, p_name AS description, {r('p_retailprice', 'price')},
  {r('CASE WHEN p_size % 2 = 1 THEN p_retailprice * 2 ELSE -1 END', 'compare_at_price')}, 'INR' AS currency, p_brand AS brand,
  'KIDS' AS gender, 'Catalog >> ' || p_type || ' >> ' || split_part(p_name, ' ', -1) AS category_path,
  'http://img/1' AS thumbnail_url, 4.3 AS rating, 7 AS review_count, 'ACTIVE' AS status,
  CASE WHEN p_size <= 50 THEN 1 ELSE 0 END AS featured
FROM part WHERE p_size <> 13 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)""")
def e1(s: Shapes) -> DataFrame:
    df = run_import(s.spark, product_file(s), known_skus(s)).filter("outcome = 'imported'")
    return flat(df.select(
        "sku", "name", "description", F.col("price").cast("double").alias("price"),
        F.coalesce(F.col("compare_at_price").cast("double"), F.lit(-1.0)).alias("compare_at_price"), "currency", "brand",
        "gender", "category_path", "thumbnail_url", F.col("rating").cast("double").alias("rating"), "review_count",
        "status", F.col("featured").cast("int").alias("featured")))


def known_skus(s: Shapes) -> DataFrame:
    """Products of 30 order lines or more, over all lines, count as imported before."""
    often = s.t("lineitem").groupBy("l_partkey").count().filter("count >= 30")
    return often.select(F.concat(F.lit("U-"), F.col("l_partkey").cast("string")).alias("sku"))


STATS = """
WITH known AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30),
lines AS (SELECT p_partkey, CASE WHEN p_size = 13 THEN 'errors' WHEN p_partkey IN (SELECT * FROM known) THEN 'skipped' ELSE 'imported' END AS outcome FROM part
  UNION ALL SELECT p_partkey, 'skipped' FROM part WHERE p_size = 7)
SELECT outcome, count(*) AS rows FROM lines GROUP BY outcome"""


@query("a11_import_stats", STATS)
def a11(s: Shapes) -> DataFrame:
    return importing.import_stats(run_import(s.spark, product_file(s), known_skus(s)))


@query("a11_observed_import_stats", STATS)
def a11_observed(s: Shapes) -> DataFrame:
    """The counts that the import leaves behind while its rows are written."""
    rows, counts = importing.observed_import(run_import(s.spark, product_file(s), known_skus(s)))
    materialise(rows, "imported")
    return importing.observed_stats(s.spark, counts)


@query("s4_embedding_input", """
SELECT id, '{"id":"' || id || '","content":"Category: ' || category_name || '. ' || name || '. Brand: ' || brand || '. ' || description || '"}' AS content
FROM x_pc WHERE status = 'ACTIVE'""")
def s4(s: Shapes) -> DataFrame:
    return PF.embedding_input(s.catalog()).select("id", "content")


@query("s4_embedding_metadata", """
SELECT id, category_id, lower(brand) AS brand, """ + r("price") + ", " + r("coalesce(rating, -1)", "rating") + """
FROM x_prod WHERE status = 'ACTIVE'""")
def s4_meta(s: Shapes) -> DataFrame:
    content, meta = fresh_path(s.spark, "content"), fresh_path(s.spark, "metadata")
    PF.write_embedding_input(s.catalog(), content, meta)
    df = PF.read_metadata(s.spark, meta).withColumn("rating", F.coalesce("rating", F.lit(-1.0)))
    return flat(df, "id", "category_id", "brand", "price", "rating")
