"""The shapes of `checks.shapes` stated in SQL, and a composer for queries over them."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(body: str) -> str:
    """Prefix a query with the common table expressions it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in needed) + "\n" + body.strip()


cte("x_sold", "SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY l_partkey")
cte("x_path", """
SELECT p_partkey AS line, 'Catalog >> ' || p_type || ' >> ' || split_part(p_name, ' ', -1) AS path FROM part""")
cte("x_nodes", """
SELECT path, min(line) AS line, CAST(len(string_split(path, ' >> ')) - 1 AS INT) AS level FROM (
  SELECT line, split_part(path, ' >> ', 1) AS path FROM x_path
  UNION ALL SELECT line, split_part(path, ' >> ', 1) || ' >> ' || split_part(path, ' >> ', 2) FROM x_path
  UNION ALL SELECT line, path FROM x_path) GROUP BY path""")
cte("x_cat", """
SELECT md5(path) AS id,
  CASE WHEN row_number() OVER (PARTITION BY split_part(path, ' >> ', -1) ORDER BY line, level) = 1
       THEN split_part(path, ' >> ', -1)
       ELSE split_part(path, ' >> ', -1) || ' (' || split_part(path, ' >> ', -2) || ')' END AS name,
  path, level,
  CASE WHEN level = 0 THEN NULL
       ELSE md5(array_to_string(string_split(path, ' >> ')[1:level], ' >> ')) END AS parent_id
FROM x_nodes""")
cte("x_prod", """
SELECT CAST(p_partkey AS VARCHAR) AS id, 'SKU-' || p_partkey AS sku, p_name AS name,
  p_name || ', size ' || p_size || ' in ' || lower(p_type) AS description,
  CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (1 + p_partkey % 40) AS DECIMAL(10,2)) AS price,
  CASE WHEN p_partkey % 10 = 0 OR p_partkey % 17 = 0 THEN 0 ELSE p_size END AS stock_quantity,
  p_brand AS brand, md5('Catalog >> ' || p_type || ' >> ' || split_part(p_name, ' ', -1)) AS category_id,
  ((2 * q + n) // (2 * n)) / 10.0 AS rating, coalesce(n, 0) AS review_count,
  CASE WHEN p_partkey % 10 = 0 THEN 'OUT_OF_STOCK' WHEN p_partkey % 17 = 0 THEN 'DISCONTINUED' ELSE 'ACTIVE' END AS status,
  p_partkey % 20 = 1 AS featured
FROM part LEFT JOIN x_sold ON l_partkey = p_partkey""")
cte("x_pc", """
SELECT p.*, c.name AS category_name, c.path AS category_path FROM x_prod p LEFT JOIN x_cat c ON c.id = p.category_id""")
cte("x_part", """
SELECT part.*, c.name AS category FROM part JOIN x_cat c
  ON c.path = 'Catalog >> ' || p_type || ' >> ' || split_part(p_name, ' ', -1)""")
cte("x_ev", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  user_id || '-' || CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END AS session_id,
  CAST(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS TIMESTAMP) AS event_time, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  (event_id * 7 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % (SELECT count(*) FROM part) AS p_partkey
FROM events""")
cte("x_views", """
SELECT e.event_id, e.user_id, e.session_id, e.event_time, CAST(e.p_partkey AS VARCHAR) AS product_id,
  p_name AS product_name, category,
  CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (1 + e.p_partkey % 40) AS DOUBLE) AS price,
  CASE WHEN k % 3 = 0 THEN p_name ELSE '' END AS search_query,
  CAST(round(value * 1000) AS BIGINT) AS view_duration_ms
FROM x_ev e JOIN x_part p ON e.p_partkey = p.p_partkey WHERE event_type = 'view'""")
cte("x_carts", """
SELECT e.event_id, e.user_id, e.session_id, e.event_time,
  CASE WHEN event_type = 'purchase' THEN 'ADD' ELSE 'REMOVE' END AS action,
  CAST(e.p_partkey AS VARCHAR) AS product_id, category, value AS cart_total, k % 5 AS cart_item_count
FROM x_ev e JOIN x_part p ON e.p_partkey = p.p_partkey WHERE event_type IN ('purchase', 'error')""")
cte("x_users", """
SELECT event_id, user_id, session_id, event_time,
  CASE WHEN event_type = 'click' THEN 'PAGE_VIEW' ELSE 'LOGIN' END AS event_type,
  CASE WHEN event_type = 'click' THEN ['HOME', 'CATEGORY', 'PRODUCT', 'CART', 'CHECKOUT'][k % 5 + 1] ELSE '' END AS page_type,
  ['MOBILE', 'DESKTOP', 'TABLET'][k % 3 + 1] AS device_type
FROM x_ev WHERE event_type IN ('click', 'signup')""")
cte("x_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS total,
  ['UPI', 'CARD', 'NETBANKING', 'COD', 'WALLET'][o_orderkey % 5 + 1] AS payment_method, o_orderstatus AS status,
  CAST(o_orderdate AS TIMESTAMP) AS event_time, o_orderkey FROM orders""")
cte("x_items", """
SELECT o.order_id AS event_id, o.*, CAST(l_partkey AS VARCHAR) AS product_id, category,
  row_number() OVER (PARTITION BY o.order_id ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS item_pos
FROM x_orders o JOIN lineitem ON l_orderkey = o_orderkey JOIN x_part ON p_partkey = l_partkey""")
cte("x_ai", """
SELECT conv_id || '-' || turn AS event_id, CAST(conv_id AS VARCHAR) AS user_id, text AS query,
  ['searchProducts', 'getProductDetails', 'compareProducts'][turn % 3 + 1] AS tool_name,
  ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', ''][(conv_id + turn) % 7 + 1] AS category,
  0.0 AS min_price, CAST((conv_id % 4) * 700 AS DOUBLE) AS max_price, turn * 2 AS results_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS event_time
FROM conversations WHERE role = 'user'""")
cte("x_ord", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'ORD-' || o_orderkey AS order_number, CAST(o_custkey AS VARCHAR) AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'PENDING' ELSE 'CONFIRMED' END AS status,
  CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders""")
cte("x_lines", """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, l_linenumber AS line,
  CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal FROM lineitem""")
cte("x_cart", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderstatus = 'P'""")
cte("x_cartline", """
SELECT CAST(l_orderkey AS VARCHAR) AS cart_id, CAST(l_partkey AS VARCHAR) AS product_id,
  CAST(l_quantity AS INT) AS quantity, price AS unit_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'P'
JOIN x_prod ON x_prod.id = CAST(l_partkey AS VARCHAR)""")

# ---- activity ----
cte("x_a1p", """
SELECT user_id, session_id, list(product_id ORDER BY event_time, event_id)[1:10] AS recent_product_ids,
  count(*) AS total_product_views, coalesce(sum(view_duration_ms) // count(view_duration_ms), 0) AS avg_view_duration_ms,
  avg(price) AS avg_product_price, max(price) AS max_viewed_price, min(price) AS min_viewed_price, max(event_time) AS t
FROM x_views GROUP BY user_id, session_id""")
cte("x_a1c", """
SELECT user_id, session_id, list(category ORDER BY o)[1:5] AS recent_categories FROM (
  SELECT user_id, session_id, category, min((event_time, event_id)) AS o FROM x_views GROUP BY ALL)
GROUP BY user_id, session_id""")
cte("x_a1q", """
SELECT user_id, session_id, list(search_query ORDER BY o) AS recent_search_queries FROM (
  SELECT user_id, session_id, search_query, min((event_time, event_id)) AS o FROM x_views GROUP BY ALL)
GROUP BY user_id, session_id""")
cte("x_a1", """
SELECT * FROM x_a1p JOIN x_a1c USING (user_id, session_id) JOIN x_a1q USING (user_id, session_id)""")
cte("x_a2", """
SELECT user_id, session_id, arg_max(cart_total, (event_time, event_id)) AS current_cart_total,
  arg_max(cart_item_count, (event_time, event_id)) AS current_cart_items,
  count(*) FILTER (action = 'ADD') AS cart_adds, count(*) FILTER (action = 'REMOVE') AS cart_removes,
  max(event_time) AS t, any_value(cart_product_ids) AS cart_product_ids, any_value(cart_categories) AS cart_categories
FROM x_carts
LEFT JOIN (SELECT user_id, session_id, list(product_id ORDER BY o) AS cart_product_ids FROM (
  SELECT user_id, session_id, product_id, min((event_time, event_id)) AS o FROM x_carts WHERE action = 'ADD' GROUP BY ALL)
  GROUP BY ALL) USING (user_id, session_id)
LEFT JOIN (SELECT user_id, session_id, list(category ORDER BY o) AS cart_categories FROM (
  SELECT user_id, session_id, category, min((event_time, event_id)) AS o FROM x_carts WHERE action = 'ADD' GROUP BY ALL)
  GROUP BY ALL) USING (user_id, session_id)
GROUP BY user_id, session_id""")
cte("x_a3", """
SELECT user_id, session_id, arg_min(device_type, (event_time, event_id)) AS device_type, count(*) AS total_page_views,
  count(DISTINCT page_type) AS unique_page_types,
  count(*) FILTER (event_type = 'PAGE_VIEW' AND page_type = 'PRODUCT') AS product_page_views,
  count(*) FILTER (event_type = 'PAGE_VIEW' AND page_type = 'CART') AS cart_page_views,
  count(*) FILTER (event_type = 'PAGE_VIEW' AND page_type = 'CHECKOUT') AS checkout_page_views,
  (epoch_us(max(event_time)) - epoch_us(min(event_time))) // 1000000 * 1000 AS session_duration_ms, max(event_time) AS t
FROM x_users GROUP BY user_id, session_id""")
cte("x_a4", """
SELECT user_id, count(*) AS ai_search_count,
  list(query ORDER BY event_time, event_id)[1:10] AS ai_search_queries,
  any_value(cats) AS ai_search_categories, avg(min_price) AS ai_avg_min_price, avg(max_price) AS ai_avg_max_price,
  max(max_price) AS ai_max_budget, count(*) FILTER (tool_name = 'searchProducts') AS ai_product_searches,
  count(*) FILTER (tool_name = 'getProductDetails') AS ai_product_detail_views,
  count(*) FILTER (tool_name = 'compareProducts') AS ai_product_comparisons,
  CAST(sum(results_count) AS BIGINT) AS ai_total_results_shown, max(event_time) AS t
FROM x_ai JOIN (SELECT user_id, list(category ORDER BY o)[1:5] AS cats FROM (
  SELECT user_id, category, min((event_time, event_id)) AS o FROM x_ai GROUP BY ALL) GROUP BY user_id) USING (user_id)
GROUP BY user_id""")
cte("x_a5", """
SELECT user_id, count(DISTINCT order_id) AS total_orders, sum(total) AS total_spent, avg(total) AS avg_order_value,
  0.0 AS total_discount, arg_max(total, (event_time, event_id, item_pos)) AS last_order_total,
  any_value(purchased_categories) AS purchased_categories, any_value(purchased_product_ids) AS purchased_product_ids,
  arg_max(payment_method, (event_time, event_id, item_pos)) AS preferred_payment_method,
  arg_max(status, (event_time, event_id, item_pos)) AS last_order_status, max(event_time) AS t
FROM x_items
JOIN (SELECT user_id, list(category ORDER BY o)[1:10] AS purchased_categories FROM (
  SELECT user_id, category, min((event_time, event_id, item_pos)) AS o FROM x_items GROUP BY ALL) GROUP BY ALL) USING (user_id)
JOIN (SELECT user_id, list(product_id ORDER BY o)[1:20] AS purchased_product_ids FROM (
  SELECT user_id, product_id, min((event_time, event_id, item_pos)) AS o FROM x_items GROUP BY ALL) GROUP BY ALL) USING (user_id)
GROUP BY user_id""")
PROFILE_SELECT = """
SELECT p.user_id, p.session_id, recent_product_ids, recent_categories, recent_search_queries, total_product_views,
  avg_view_duration_ms, avg_product_price,
  CASE WHEN coalesce(ai_max_budget, 0) > 0 AND ai_max_budget < 500 THEN 'BUDGET'
       WHEN coalesce(ai_max_budget, 0) > 0 AND ai_max_budget < 2000 THEN 'MID_RANGE'
       WHEN coalesce(ai_max_budget, 0) > 0 THEN 'PREMIUM'
       WHEN avg_product_price < 500 THEN 'BUDGET' WHEN avg_product_price < 2000 THEN 'MID_RANGE'
       ELSE 'PREMIUM' END AS price_preference,
  coalesce(current_cart_total, 0.0) AS current_cart_total, coalesce(current_cart_items, 0) AS current_cart_items,
  coalesce(cart_adds, 0) AS cart_adds, coalesce(cart_product_ids, ['']) AS cart_product_ids,
  coalesce(cart_categories, ['']) AS cart_categories, coalesce(device_type, 'UNKNOWN') AS device_type,
  coalesce(session_duration_ms, 0) AS session_duration_ms, coalesce(total_page_views, 0) AS total_page_views,
  coalesce(product_page_views, 0) AS product_page_views, coalesce(cart_page_views, 0) AS cart_page_views,
  coalesce(checkout_page_views, 0) AS checkout_page_views, coalesce(ai_search_count, 0) AS ai_search_count,
  coalesce(ai_search_queries, ['']) AS ai_search_queries, coalesce(ai_search_categories, ['']) AS ai_search_categories,
  coalesce(ai_max_budget, 0.0) AS ai_max_budget, coalesce(ai_product_searches, 0) AS ai_product_searches,
  coalesce(ai_product_comparisons, 0) AS ai_product_comparisons, coalesce(total_orders, 0) AS total_orders,
  coalesce(total_spent, 0.0) AS total_spent, coalesce(avg_order_value, 0.0) AS avg_order_value,
  coalesce(last_order_total, 0.0) AS last_order_total,
  coalesce(preferred_payment_method, 'NONE') AS preferred_payment_method,
  strftime(greatest(p.t, coalesce(c.t, TIMESTAMP '1970-01-01'), coalesce(s.t, TIMESTAMP '1970-01-01'),
    coalesce(a.t, TIMESTAMP '1970-01-01'), coalesce(o.t, TIMESTAMP '1970-01-01')), '%Y-%m-%d %H:%M:%S') AS last_updated,
  p.t AS pt
"""
cte("x_prof", PROFILE_SELECT + """FROM x_a1 p LEFT JOIN x_a2 c USING (user_id, session_id) LEFT JOIN x_a3 s USING (user_id, session_id)
LEFT JOIN x_a4 a USING (user_id) LEFT JOIN x_a5 o USING (user_id)""")
# A right row counts only while its last event is at most six hours older than the left one's.
cte("x_prof_ttl", PROFILE_SELECT + "FROM x_a1 p " + " ".join(
    f"LEFT JOIN {table} {t} ON {' AND '.join(f'{t}.{k} = p.{k}' for k in keys)} AND {t}.t >= p.t - INTERVAL 6 HOUR"
    for t, table, keys in (("c", "x_a2", ["user_id", "session_id"]), ("s", "x_a3", ["user_id", "session_id"]),
                           ("a", "x_a4", ["user_id"]), ("o", "x_a5", ["user_id"]))))
