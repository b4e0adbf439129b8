"""Events, activity and profiles on hand-made rows."""

from pyspark.sql import functions as F

from tradewind.operators import activity as A, events as E, profiles as P, ranking as R
from tradewind.schemas import PROFILE, TOPICS, from_wire

VIEW = ["event_id", "user_id", "session_id", "product_id", "product_name", "category", "price", "source",
        "search_query", "view_duration_ms", "timestamp"]


def views(spark, rows):
    return spark.createDataFrame(rows, from_wire(spark.createDataFrame([], TOPICS["product-views"])).schema)


def view(n, product="p", category="c", price=1.0, query="", at="2024-01-01 00:00:00.000", session="s", user="u", ms=10):
    return (str(n), user, session, product, product, category, price, "SEARCH", query, ms, at)


def test_unreadable_times_are_dropped(spark):
    stamps = [None, "", "yesterday", "2024-01-01 10:00:00.123", "2024-01-01T10:00:00Z"]
    df = views(spark, [view(i, at=t) for i, t in enumerate(stamps)])
    assert sorted(r.event_id for r in E.timed_events(df).collect()) == ["3", "4"]
    ai = spark.createDataFrame([(str(i), t) for i, t in enumerate(
        ["2024-01-01T10:00:00.987654Z", "2024-01-01 10:00:00", "", None])], "event_id string, timestamp string")
    rows = E.timed_ai_events(ai).collect()
    assert [(r.event_id, str(r.event_time)) for r in rows] == [("0", "2024-01-01 10:00:00")]


def test_product_activity_caps_order_and_ties(spark):
    rows = [view(f"{i:02d}", product=f"p{i}", category=f"c{i % 7}", query="q" if i % 2 else "", price=float(i),
                 at=f"2024-01-01 00:00:{i // 2:02d}.000", ms=i) for i in range(14)]
    for parts in (1, 5):  # the arrangement of the input must not matter
        df = E.timed_events(views(spark, rows[::-1]).repartition(parts))
        r = A.product_activity(df).first()
        assert r.recent_product_ids == [f"p{i}" for i in range(10)]
        assert r.recent_categories == [f"c{i}" for i in range(5)]
        assert r.recent_search_queries == ["", "q"]
        assert (r.total_product_views, r.avg_view_duration_ms, r.avg_product_price) == (14, 6, 6.5)
        last = A.product_activity(df, keep="last").first()
        assert last.recent_product_ids == [f"p{i}" for i in range(4, 14)]
        assert last.recent_categories == ["c2", "c3", "c4", "c5", "c6"]


def test_cart_activity_without_adds_is_blank(spark):
    schema = ("event_id string, user_id string, session_id string, action string, product_id string, category string, "
              "cart_total double, cart_item_count int, event_time timestamp_ntz")
    import datetime as d
    t = lambda s: d.datetime(2024, 1, 1, 0, 0, s)
    rows = [("1", "u", "a", "REMOVE", "p1", "c1", 5.0, 1, t(1)), ("2", "u", "a", "REMOVE", "p2", "c1", None, None, t(2)),
            ("3", "u", "b", "ADD", "p1", "c1", 7.0, 1, t(3)), ("4", "u", "b", "ADD", "p1", "c2", 9.0, 2, t(4))]
    got = {r.session_id: r for r in A.cart_activity(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].cart_product_ids == [""] and got["a"].cart_removes == 2
    assert got["a"].current_cart_total == 5.0 and got["a"].current_cart_items == 1  # nulls are not a last value
    assert got["b"].cart_product_ids == ["p1"] and got["b"].cart_categories == ["c1", "c2"]


def orders(spark):
    import datetime as d
    item = lambda p, c: (p, p, c, 1, 1.0)
    rows = [("e1", "u", "o1", 10.0, 1.0, "UPI", "PLACED", d.datetime(2024, 1, 1), []),
            ("e2", "u", "o2", 20.0, 2.0, "CARD", "CANCELLED", d.datetime(2024, 1, 2), [item("p1", "c1")]),
            ("e3", "u", "o3", 30.0, 3.0, "COD", "PLACED", d.datetime(2024, 1, 3),
             [item("p1", "c1"), item("p2", "c2"), item("p3", "c1")])]
    return spark.createDataFrame(rows, "event_id string, user_id string, order_id string, total double, discount double, "
                                 "payment_method string, status string, event_time timestamp, items array<struct<"
                                 "product_id:string,product_name:string,category:string,quantity:int,price:double>>")


def test_order_amounts_repeat_per_line(spark):
    items = E.flatten_order_items(orders(spark))
    assert items.count() == 4
    r = A.order_activity(items).first()
    assert (r.total_orders, r.total_spent, r.avg_order_value, r.total_discount) == (2, 110.0, 27.5, 11.0)
    assert r.purchased_product_ids == ["p1", "p2", "p3"] and r.last_order_total == 30.0
    once = A.order_activity(items, per_order=True).first()
    assert (once.total_spent, once.avg_order_value) == (50.0, 25.0)


def test_price_preference_edges(spark):
    rows = [(0.0, 499.99), (0.0, 500.0), (None, None), (0.0, 2000.0), (300.0, 9999.0), (500.0, 1.0), (2000.0, 1.0)]
    df = spark.createDataFrame(rows, "b double, p double").select(P.price_preference(F.col("b"), F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == ["BUDGET", "MID_RANGE", "BUDGET", "PREMIUM", "BUDGET", "MID_RANGE", "PREMIUM"]


def profile(user, session, at, **values):
    row = {f.name: None for f in PROFILE}
    for f in PROFILE:
        kind = f.dataType.simpleString()
        row[f.name] = {"bigint": 0, "double": 0.0, "string": "", "array<string>": [""]}[kind]
    return {**row, "user_id": user, "session_id": session, "last_updated": at, **values}


def test_fold_equals_step_by_step_merge(spark):
    many = [f"x{i}" for i in range(30)]
    steps = [
        profile("u", "s1", "2024-01-01 00:00:00", recent_product_ids=many, total_orders=3, price_preference="BUDGET",
                ai_max_budget=900.0, preferred_payment_method="UPI", avg_product_price=5.0),
        profile("u", "s2", "2024-01-02 00:00:00", recent_product_ids=["x5", " ", "new", "x1"], cart_categories=["a", "b"],
                price_preference="UNKNOWN", preferred_payment_method="NONE", ai_max_budget=100.0, total_page_views=4),
        profile("u", "s3", "2024-01-03 00:00:00", recent_product_ids=["z"] + many[10:], cart_categories=["b", "c"],
                price_preference="PREMIUM", preferred_payment_method="CARD", current_cart_total=8.0),
        profile("v", "s1", "2024-01-01 00:00:00", recent_product_ids=[""], recent_search_queries=many),
    ]
    frames = [spark.createDataFrame([s], PROFILE) for s in steps]
    merged = frames[0]
    for f in frames[1:3]:
        merged = P.merge_profiles(merged, f, "now")
    history = frames[0]
    for f in frames[1:]:
        history = history.unionByName(f)
    folded = {r.user_id: r.asDict() for r in P.fold_profiles(history.repartition(3), ["last_updated"], "now").collect()}
    assert folded["u"] == merged.first().asDict()
    assert folded["v"] == frames[3].first().asDict()  # a first profile is stored as it is
    assert len(folded["u"]["recent_product_ids"]) == 20 and folded["u"]["total_orders"] == 3


def test_profile_ttl_edge(spark):
    df = spark.createDataFrame([profile("u", "s", "2024-01-01 00:00:00")], PROFILE)
    assert P.live_profiles(df, "2024-01-01 00:59:59").count() == 1
    assert P.live_profiles(df, "2024-01-01 01:00:00").count() == 0


def test_ttl_epochs_match_a_plain_scan(spark):
    import datetime as d
    import random
    rng, base, rows = random.Random(3), d.datetime(2024, 1, 1), []
    for key in "ab":
        at = base
        for i in range(60):
            at += d.timedelta(seconds=rng.choice([1, 1799, 3599, 3600, 3601, 9000]))
            rows.append((key, i, at))
    want, last = {}, {}
    for key, i, at in rows:
        before, epoch = last.get(key, (at, 0))
        epoch += (at - before).total_seconds() > 3600
        want[key, i], last[key] = epoch, (at, epoch)
    df = spark.createDataFrame(rows, "k string, i int, event_time timestamp").repartition(7)
    assert {(r.k, r.i): r.epoch for r in R.ttl_epochs(df, ["k"], 3600).collect()} == want
    kept = {(r.k, r.i) for r in R.expire_idle(df, ["k"], 3600).collect()}
    assert kept == {key for key, e in want.items() if e == last[key[0]][1]}


def test_collected_lists_are_sorted_by_compiled_code(spark, capsys):
    """a profile build spent a quarter of its time in interpreted comparisons of array_sort."""
    rows = [("u", "s", 3, "b", "e3"), ("u", "s", 1, "a", "e2"), ("u", "s", 1, None, "e1"), ("u", "s", None, "z", "e9"),
            ("u", "s", 1, "c", "e0"), ("v", "t", 2, None, "e4")]
    df = spark.createDataFrame(rows, "user_id string, session_id string, at int, product_id string, event_id string")
    from tradewind.operators.collecting import distinct_values, first_values

    where = (df, ["user_id", "session_id"], "product_id", ["at", "event_id"])
    for found in (first_values(*where, 10, "got"), distinct_values(*where, "got")):
        assert [tuple(r) for r in found.collect()] == [("u", "s", ["z", "c", "a", "b"])]
        found.explain(True)
        plan = capsys.readouterr().out
        assert "sort_array" in plan and "lambdafunction" not in plan
