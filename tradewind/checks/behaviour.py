"""Queries over events, activity and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import arrays as A
from ..operators import activity, events, profiles
from ..operators.collecting import distinct_values, first_value, first_values, last_value
from ..operators.ranking import expire_idle, latest_by_key, ttl_epochs
from ..plans.profile_build import build_profiles_from_events
from ..schemas import PROFILE
from ..session import fresh_path, materialise
from ..sources.keyed_store import KeyedStore, change_store, create_store
from ..sources.profile_store import write_profiles
from ..sources.topics import read_events
from .registry import flat, j, query, r
from .shapes import Shapes

A1_COLS = (f"user_id, session_id, {j('recent_product_ids')}, {j('recent_categories')}, "
           f"{j('recent_search_queries')}, total_product_views, "
           "avg_view_duration_ms, " + r("avg_product_price") + ", max_viewed_price, min_viewed_price, "
           "strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time")


@query("a1_product_activity", f"SELECT {A1_COLS} FROM x_a1")
def a1(s: Shapes) -> DataFrame:
    return flat(activity.product_activity(s.timed_views()))


@query("a2_cart_activity", f"""
SELECT user_id, session_id, current_cart_total, current_cart_items, cart_adds, cart_removes,
  {j("coalesce(cart_product_ids, [''])", "cart_product_ids")}, {j("coalesce(cart_categories, [''])", "cart_categories")},
  strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time FROM x_a2""")
def a2(s: Shapes) -> DataFrame:
    return flat(activity.cart_activity(s.timed_carts()))


@query("a3_session_activity",
       "SELECT * EXCLUDE (t), strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time FROM x_a3")
def a3(s: Shapes) -> DataFrame:
    return flat(activity.session_activity(s.timed_users()))


@query("a4_ai_activity", f"""
SELECT * EXCLUDE (t, ai_avg_min_price, ai_avg_max_price, ai_search_queries, ai_search_categories),
  {j("ai_search_queries")}, {j("ai_search_categories")}, {r("ai_avg_min_price")}, {r("ai_avg_max_price")}, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time FROM x_a4""")
def a4(s: Shapes) -> DataFrame:
    return flat(activity.ai_activity(s.timed_ai()))


@query("a5_order_activity", f"""
SELECT * EXCLUDE (t, total_spent, avg_order_value, total_discount, purchased_categories, purchased_product_ids),
  {j("purchased_categories")}, {j("purchased_product_ids")}, {r("total_spent")}, {r("avg_order_value")},
  0.0 AS total_discount,
  strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time FROM x_a5""")
def a5(s: Shapes) -> DataFrame:
    return flat(activity.order_activity(s.order_items()))


@query("a5_order_activity_per_order", f"""
SELECT user_id, count(*) AS total_orders, {r("sum(total)", "total_spent")}, {r("avg(total)", "avg_order_value")}
FROM (SELECT DISTINCT user_id, order_id, total FROM x_items) GROUP BY user_id""")
def a5_per_order(s: Shapes) -> DataFrame:
    df = activity.order_activity(s.order_items(), per_order=True)
    return flat(df, "user_id", "total_orders", "total_spent", "avg_order_value")


def profiles_of(s: Shapes) -> DataFrame:
    return build_profiles_from_events(s.product_views(), s.cart_events(), s.user_events(), s.ai_events(),
                                      s.order_events())


PROFILE_SQL_COLS = ", ".join(
    r(f.name) if isinstance(f.dataType, T.DoubleType) else j(f.name) if isinstance(f.dataType, T.ArrayType)
    else f.name for f in PROFILE)


@query("j1_build_user_profiles", f"SELECT {PROFILE_SQL_COLS} FROM x_prof")
def j1(s: Shapes) -> DataFrame:
    return flat(profiles_of(s))


# ---- sources, projections, collections ----

READ_COLUMNS = ("event_id", "user_id", "session_id", "product_id", "category", "search_query", "view_duration_ms", "price")
READ_SQL = f"SELECT {', '.join(READ_COLUMNS[:-1])}, " + r("price") + " FROM x_views"


@query("s1_read_events", READ_SQL)
def s1(s: Shapes) -> DataFrame:
    path = fresh_path(s.spark, "product-views")
    s.wire("product-views").write.parquet(path)
    return flat(read_events(s.spark, "product-views", path), *READ_COLUMNS)


@query("s1_read_events_json", "SELECT order_id, user_id, payment_method, status, " + r("total") + ", count(product_id) AS items "
       "FROM x_orders LEFT JOIN x_items USING (order_id, user_id, payment_method, status, total) GROUP BY ALL")
def s1_json(s: Shapes) -> DataFrame:
    path = fresh_path(s.spark, "order-events")
    s.wire("order-events").write.json(path)
    events_ = read_events(s.spark, "order-events", path, fmt="json")
    return flat(events_.withColumn("items", F.size("items").cast("bigint")), "order_id", "user_id", "payment_method",
                "status", "total", "items")


@query("p1_timed_events", """
SELECT 'views' AS topic, event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM x_views
UNION ALL SELECT 'carts', event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') FROM x_carts
UNION ALL SELECT 'users', event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') FROM x_users
UNION ALL SELECT 'orders', order_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') FROM x_orders""")
def p1(s: Shapes) -> DataFrame:
    out = None
    for name, df in (("views", s.timed_views()), ("carts", s.timed_carts()), ("users", s.timed_users()),
                     ("orders", s.timed_orders())):
        part = flat(df.select(F.lit(name).alias("topic"), "event_id", "event_time"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p2_timed_ai_events", "SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM x_ai")
def p2(s: Shapes) -> DataFrame:
    return flat(s.timed_ai().select("event_id", "event_time"))


@query("j2_flatten_order_items", "SELECT user_id, order_id, item_pos, product_id, category, " + r("total") + " FROM x_items")
def j2(s: Shapes) -> DataFrame:
    return flat(s.order_items(), "user_id", "order_id", "item_pos", "product_id", "category", "total")


USER_ORDER = ["event_time", "event_id"]


@query("c1_first_n", """
SELECT user_id, array_to_string(list(product_id ORDER BY event_time, event_id)[1:10], '|') AS products
FROM x_views GROUP BY user_id""")
def c1(s: Shapes) -> DataFrame:
    return flat(first_values(s.timed_views(), ["user_id"], "product_id", USER_ORDER, 10, "products"))


@query("c1_last_n", """
SELECT user_id, array_to_string(list_reverse(list(product_id ORDER BY event_time DESC, event_id DESC)[1:10]), '|') AS products
FROM x_views GROUP BY user_id""")
def c1_last(s: Shapes) -> DataFrame:
    return flat(first_values(s.timed_views(), ["user_id"], "product_id", USER_ORDER, 10, "products", keep="last"))


@query("c2_first_n_distinct", """
SELECT user_id, array_to_string(list(category ORDER BY o)[1:5], '|') AS categories
FROM (SELECT user_id, category, min((event_time, event_id)) AS o FROM x_carts GROUP BY ALL) GROUP BY user_id""")
def c2(s: Shapes) -> DataFrame:
    return flat(distinct_values(s.timed_carts(), ["user_id"], "category", USER_ORDER, "categories", 5))


@query("c3_array_default_blank", """
SELECT user_id, session_id, len(CASE WHEN len(l) = 0 OR l IS NULL THEN [''] ELSE l END) AS entries,
  array_to_string(CASE WHEN len(l) = 0 OR l IS NULL THEN [''] ELSE l END, '|') AS products
FROM (SELECT user_id, session_id, list(product_id ORDER BY event_time, event_id) FILTER (action = 'ADD')[1:10] AS l
      FROM x_carts GROUP BY ALL)""")
def c3(s: Shapes) -> DataFrame:
    carts = s.timed_carts()
    adds = first_values(carts.filter("action = 'ADD'"), activity.SESSION, "product_id", USER_ORDER, 10, "products")
    all_ = carts.select(*activity.SESSION).distinct().join(adds, activity.SESSION, "left")
    return flat(all_.withColumn("products", A.default_blank(F.col("products")))
                .withColumn("entries", F.size("products")))


@query("c4_first_last_value", """
SELECT user_id, arg_min(device_type, (event_time, event_id)) AS first_device,
  arg_max(page_type, (event_time, event_id)) AS last_page FROM x_users GROUP BY user_id""")
def c4(s: Shapes) -> DataFrame:
    return s.timed_users().groupBy("user_id").agg(
        first_value("device_type", USER_ORDER).alias("first_device"),
        last_value("page_type", USER_ORDER).alias("last_page"))


MERGED = ("list_filter(list_concat(list_filter({a}, lambda x: trim(x) <> ''), list_filter({b}, lambda x: trim(x) <> '')), "
          "lambda x, i: list_position(list_concat(list_filter({a}, lambda x: trim(x) <> ''), "
          "list_filter({b}, lambda x: trim(x) <> '')), x) = i)[1:{n}]")


def merged(a: str, b: str, n: int) -> str:
    return MERGED.format(a=a, b=b, n=n)


@query("c5_merge_lists", f"""
SELECT a.user_id, {j(merged("b.recent_product_ids", "a.recent_product_ids", 20), "products")},
  {j(merged("b.recent_search_queries", "a.recent_search_queries", 10), "queries")}
FROM x_prof a JOIN x_prof b ON a.user_id = b.user_id AND a.session_id < b.session_id""")
def c5(s: Shapes) -> DataFrame:
    p = profiles_staged(s)
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.session_id") < F.col("b.session_id")))
    return flat(both.select(
        F.col("a.user_id"),
        A.merge_lists(F.col("b.recent_product_ids"), F.col("a.recent_product_ids"), 20).alias("products"),
        A.merge_lists(F.col("b.recent_search_queries"), F.col("a.recent_search_queries"), 10).alias("queries")))


@query("c6_latest_event_time", """
SELECT coalesce(a.user_id, o.user_id) AS user_id, strftime(greatest(coalesce(a.t, TIMESTAMP '1970-01-01'),
  coalesce(o.t, TIMESTAMP '1970-01-01')), '%Y-%m-%d %H:%M:%S') AS latest
FROM x_a4 a FULL JOIN x_a5 o ON a.user_id = o.user_id""")
def c6(s: Shapes) -> DataFrame:
    a = s.timed_ai().groupBy("user_id").agg(F.max("event_time").alias("_a"))
    o = s.order_items().groupBy("user_id").agg(F.max("event_time").alias("_o"))
    return a.join(o, "user_id", "full").select("user_id", A.latest_time_text(F.col("_a"), F.col("_o")).alias("latest"))


@query("p13_price_preference", """
SELECT c_custkey, CASE WHEN b > 0 THEN CASE WHEN b < 500 THEN 'BUDGET' WHEN b < 2000 THEN 'MID_RANGE' ELSE 'PREMIUM' END
  ELSE CASE WHEN p < 500 THEN 'BUDGET' WHEN p < 2000 THEN 'MID_RANGE' ELSE 'PREMIUM' END END AS preference
FROM (SELECT c_custkey, (c_custkey % 4) * 700 AS b, abs(c_acctbal) AS p FROM customer)""")
def p13(s: Shapes) -> DataFrame:
    return s.t("customer").select("c_custkey", profiles.price_preference(
        ((F.col("c_custkey") % 4) * 700).cast("double"), F.abs("c_acctbal")).alias("preference"))


@query("p14_price_range", """
SELECT preference, count(*) AS products FROM x_prod JOIN (VALUES ('BUDGET', 0, 500), ('MID_RANGE', 500, 2000),
  ('PREMIUM', 2000, 1e12), ('UNKNOWN', 0, 1e12)) AS b(preference, lo, hi) ON price >= lo AND price <= hi GROUP BY preference""")
def p14(s: Shapes) -> DataFrame:
    bands = F.explode(F.array(*[F.lit(b) for b in ("BUDGET", "MID_RANGE", "PREMIUM", "UNKNOWN")]))
    low, high = profiles.price_range(F.col("preference"))
    rows = s.products().select("price", bands.alias("preference"))
    return rows.filter((low.isNull() | (F.col("price") >= low)) & (high.isNull() | (F.col("price") <= high))).groupBy(
        "preference").agg(F.count("*").alias("products"))


@query("f16_safe_casts", """
SELECT event_id, coalesce(CAST(trunc(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS BIGINT), 0) AS k,
  0 AS not_a_number, """ + r("coalesce(value, 0.0)", "value") + " FROM events")
def f16(s: Shapes) -> DataFrame:
    return flat(s.t("events").select(
        "event_id", A.safe_long(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
        A.safe_long(F.col("props")).alias("not_a_number"), A.safe_double(F.col("value")).alias("value")))


# ---- profiles ----

def profiles_staged(s: Shapes) -> DataFrame:
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _PROFILES:
        _PROFILES[key] = materialise(profiles_of(s), "profiles")
    return _PROFILES[key]


_PROFILES: dict = {}
AS_OF = "2024-02-01 00:00:00"


def _merge_sql(single: str) -> str:
    """Merge of the second session's profile into the first's, column by column."""
    out = []
    for f in PROFILE:
        c = f.name
        if c in profiles.LIST_CAPS:
            e = merged(f"b.{c}", f"a.{c}", profiles.LIST_CAPS[c])
            e = f"CASE WHEN b.user_id IS NULL THEN a.{c} WHEN a.user_id IS NULL THEN b.{c} ELSE {e} END"
            out.append(j(e, c))
            continue
        if c == "user_id":
            e = "coalesce(b.user_id, a.user_id)"
        elif c == "last_updated":
            e = f"CASE WHEN b.user_id IS NULL THEN a.{c} WHEN a.user_id IS NULL THEN b.{c} ELSE '{AS_OF}' END"
        else:
            if c in profiles.POSITIVE_COUNT or c in profiles.POSITIVE_AMOUNT:
                m = f"CASE WHEN b.{c} > 0 THEN b.{c} ELSE a.{c} END"
            elif c in profiles.MEANINGFUL:
                other = profiles.MEANINGFUL[c] or ""
                m = f"CASE WHEN b.{c} IS NOT NULL AND b.{c} <> '{other}' THEN b.{c} ELSE a.{c} END"
            elif c == "ai_max_budget":
                m = f"greatest(a.{c}, b.{c})"
            else:
                m = f"b.{c}"
            e = f"CASE WHEN b.user_id IS NULL THEN a.{c} WHEN a.user_id IS NULL THEN b.{c} ELSE {m} END"
        out.append(r(e, c) if isinstance(f.dataType, T.DoubleType) else f"{e} AS {c}")
    return ("SELECT " + ",\n  ".join(out) + " FROM (SELECT * FROM x_prof WHERE session_id LIKE '%-a') a "
            "FULL JOIN (SELECT * FROM x_prof WHERE session_id LIKE '%-b') b ON a.user_id = b.user_id")


@query("r1_merge_profiles", _merge_sql("b"))
def r1_merge(s: Shapes) -> DataFrame:
    p = profiles_staged(s)
    return flat(profiles.merge_profiles(
        p.filter(F.col("session_id").endswith("-a")), p.filter(F.col("session_id").endswith("-b")), AS_OF))


@query("r1_fold_profiles", _merge_sql("b"))
def r1_fold(s: Shapes) -> DataFrame:
    return flat(profiles.fold_profiles(profiles_staged(s), ["session_id"], AS_OF))


@query("r2_signal_flags", """
SELECT user_id, session_id, len(recent_product_ids) > 0 AS has_views,
  len(list_filter(list_concat(recent_categories, cart_categories, ai_search_categories), lambda x: trim(x) <> '')) > 0 AS has_categories,
  len(list_filter(list_concat(recent_categories, cart_categories, ai_search_categories, ai_search_queries,
    recent_search_queries), lambda x: trim(x) <> '')) > 0 OR ai_max_budget > 0 AS has_intent FROM x_prof""")
def r2(s: Shapes) -> DataFrame:
    return profiles.with_signal_flags(profiles_staged(s)).select(
        "user_id", "session_id", "has_views", "has_categories", "has_intent")


@query("s2_write_profiles", f"SELECT {PROFILE_SQL_COLS} FROM x_prof")
def s2(s: Shapes) -> DataFrame:
    """First sessions are stored, then all profiles arrive as changes, the first ones again."""
    p = profiles_staged(s)
    first = write_profiles(s.spark, p.filter(F.col("session_id").endswith("-a")).withColumn("total_page_views", F.lit(0).cast("bigint")))
    second = write_profiles(s.spark, p, first)
    return flat(s.spark.read.schema(PROFILE).parquet(second))


def profile_store(s: Shapes) -> KeyedStore:
    """First sessions with other numbers are the base; all profiles arrive as changes; users without views leave again."""
    p = profiles_staged(s)
    first = p.filter(F.col("session_id").endswith("-a")).withColumn("total_page_views", F.lit(0).cast("bigint"))
    store = change_store(s.spark, create_store(first, ["user_id", "session_id"], buckets=16), p, compact_share=None)
    return change_store(s.spark, store, None, p.filter("total_page_views < 2").select("user_id", "session_id"), compact_share=None)


@query("s2_profile_store", f"SELECT {PROFILE_SQL_COLS} FROM x_prof WHERE NOT coalesce(total_page_views < 2, false)")
def s2_store(s: Shapes) -> DataFrame:
    """A base and two deltas, merged when they are read."""
    return flat(profile_store(s).rows(s.spark))


@query("s2_profile_store_compacted", f"SELECT {PROFILE_SQL_COLS} FROM x_prof WHERE NOT coalesce(total_page_views < 2, false)")
def s2_compacted(s: Shapes) -> DataFrame:
    """The same after every bucket was rewritten."""
    store = profile_store(s)
    return flat(change_store(s.spark, store, store.rows(s.spark).limit(0), compact_share=0.0).rows(s.spark))


@query("s8_profile_store_lookup", """
SELECT user_id, session_id, last_updated FROM x_prof WHERE NOT coalesce(total_page_views < 2, false)
  AND session_id IN (SELECT user_id || '-b' FROM x_prof) AND session_id LIKE '%-b'""")
def s8_store(s: Shapes) -> DataFrame:
    """Second sessions by their keys; only the buckets of the keys are read."""
    asked = profiles_staged(s).select("user_id", F.concat("user_id", F.lit("-b")).alias("session_id"))
    return profile_store(s).lookup(asked).select("user_id", "session_id", "last_updated")


@query("s8_profile_lookup", """
SELECT user_id, session_id, last_updated FROM x_prof
WHERE CAST(last_updated AS TIMESTAMP) + INTERVAL 1 DAY > TIMESTAMP '2024-01-31 00:00:00'
  AND user_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)""")
def s8(s: Shapes) -> DataFrame:
    users = s.orders().select("user_id")
    return profiles.lookup_profiles(profiles_staged(s), users, "2024-01-31 00:00:00", 86400).select(
        "user_id", "session_id", "last_updated")


@query("s8_list_profiles", """
SELECT user_id, session_id, last_updated FROM x_prof
WHERE CAST(last_updated AS TIMESTAMP) + INTERVAL 7 DAY > TIMESTAMP '2024-01-31 00:00:00'""")
def s8_list(s: Shapes) -> DataFrame:
    return profiles.live_profiles(profiles_staged(s), "2024-01-31 00:00:00", 7 * 86400).select(
        "user_id", "session_id", "last_updated")


@query("j1_profiles_with_ttl", f"SELECT {PROFILE_SQL_COLS} FROM x_prof_ttl")
def j1_ttl(s: Shapes) -> DataFrame:
    return flat(build_profiles_from_events(s.product_views(), s.cart_events(), s.user_events(), s.ai_events(),
                                           s.order_events(), ttl_seconds=6 * 3600))


@query("w6_latest_by_key", """
SELECT user_id, arg_max(event_id, (event_time, event_id)) AS event_id, arg_max(action, (event_time, event_id)) AS action
FROM x_carts GROUP BY user_id""")
def w6(s: Shapes) -> DataFrame:
    return latest_by_key(s.timed_carts(), ["user_id"], USER_ORDER).select("user_id", "event_id", "action")


TTL_SQL = """
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS epoch FROM (
  SELECT *, CASE WHEN epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY user_id ORDER BY event_time))
    > 43200000000 THEN 1 ELSE 0 END AS fresh FROM x_ev)"""


@query("w7_ttl_epochs", f"SELECT event_id, user_id, CAST(epoch AS BIGINT) AS epoch FROM ({TTL_SQL})")
def w7(s: Shapes) -> DataFrame:
    return ttl_epochs(all_events(s), ["user_id"], 43200).select("event_id", "user_id", "epoch")


@query("w7_expire_idle", f"""
SELECT event_id, user_id FROM ({TTL_SQL}) QUALIFY epoch = max(epoch) OVER (PARTITION BY user_id)""")
def w7_last(s: Shapes) -> DataFrame:
    return expire_idle(all_events(s), ["user_id"], 43200).select("event_id", "user_id")


def all_events(s: Shapes) -> DataFrame:
    return s.t("events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("event_time"))


@query("st5_minute_activity", """
SELECT user_id, strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS events
FROM x_ev GROUP BY ALL""")
def st5(s: Shapes) -> DataFrame:
    return flat(events.minute_activity(all_events(s)))
