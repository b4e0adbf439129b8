"""Plan shapes that must hold whatever the data: no nested-loop joins, early limits, pushed filters."""

from tradewind.operators import catalog as K, ranking as R, search as S
from tradewind.operators.collecting import first_values


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_and_tree_joins_are_equi_joins(spark):
    products = spark.createDataFrame([("1", "n", "d", "b", "ACTIVE", 1.0, 1.0)],
                                     "id string, name string, description string, brand string, status string, price double, rating double")
    queries = spark.createDataFrame([("q", "n", None, None, None)],
                                    "query_id string, query string, min_price double, max_price double, min_rating double")
    cats = spark.createDataFrame([("a", "A", "A", None, True)], "id string, name string, path string, parent_id string, active boolean")
    names = spark.createDataFrame([("A",)], "requested string")
    for df in (S.like_matches(queries, products), K.descendants(cats), S.expand_category_names(names, cats),
               S.category_id_by_name(names, cats)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_limits_apply_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v", "id AS t")
    for limited in (first_values(df, ["k"], "v", ["t"], 5, "vs"), R.top_k(df, ["k"], [df.t], 5)):
        text = plan(limited)
        # Read bottom up: the partial limit stands below the exchange.
        assert text.index("Exchange hashpartitioning") < text.index(", Partial")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id AS string) id", "'ACTIVE' status", "cast(id AS double) price", "'x' brand",
                               "cast(id AS double) rating", "repeat('x', 100) description").write.parquet(str(tmp_path / "p"))
    products = spark.read.parquet(str(tmp_path / "p"))
    text = plan(K.products_by_brand(products, "x").select("id"))
    assert "EqualTo(brand,x)" in text and "ReadSchema: struct<id:string,brand:string>" in text
    text = plan(K.Filters(min_price=3).apply(K.active_products(products)).select("id"))
    assert "GreaterThanOrEqual(price,3.0)" in text and "description" not in text and "rating" not in text


def test_newest_rows_need_no_sorted_aggregate(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "cast(id AS string) AS v")
    text = plan(R.latest_by_key(df, ["k"], ["t"]))
    assert "SortAggregate" not in text and text.index("Exchange hashpartitioning") < text.index(", Partial")
    assert {(r.k, r.t) for r in R.latest_by_key(df, ["k"], ["t"]).collect()} == {(0, 99), (1, 97), (2, 98)}


def test_folding_profiles_sorts_no_wide_aggregate(spark):
    from tradewind.operators.profiles import fold_profiles
    from tradewind.schemas import PROFILE

    text = plan(fold_profiles(spark.createDataFrame([], PROFILE), ["session_id"]))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text


def test_scratch_tables_go_with_their_owner(spark):
    import os

    from tradewind.session import materialise, scratch

    with scratch(spark):
        df = materialise(spark.range(3), "owned")
        files = [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()]
        assert all(os.path.exists(f) for f in files) and df.count() == 3
    assert files and not any(os.path.exists(f) for f in files)
