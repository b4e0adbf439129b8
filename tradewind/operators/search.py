"""Keyword search for whole tables of queries.

Queries are rows (query_id, query, min_price, max_price, min_rating); null bounds mean none.
Products carry category_name. Every join is an equi-join on a term or on a three-letter
piece of text, so no query is ever compared with every product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.terms import exploded_terms, term_sets, word_list
from ..session import materialise
from ..sources.search_index import SearchIndex
from .catalog import active_products
from .ranking import share_equal, top_k

# ---- fixed values -------------------------------------------------------------------------
# Field weights in tenths: name and category A = 1.0, brand B = 0.4, description C = 0.2.
FIELD_WEIGHTS = {"name": 10, "category_name": 10, "brand": 4, "description": 2}
LIKE_FIELDS = ["name", "description", "brand"]
# -------------------------------------------------------------------------------------------
PIECE_ROWS = 500_000  # postings of one term or letter piece that meet queries in one task's group
UNIT = 1_000_000  # scores are summed as whole millionths
REQUEST_ROWS, PRODUCT_ROWS = 1_000, 4_096  # queries and products of one request that travel in a list
LIST_IDS = 256  # products that a query takes before the next one
TASK_MATCHES = 16_000_000  # rows that one task makes of lists
FIRST_ROWS = 1_024  # postings of a query's first blocks
REQUEST = ["query", "min_price", "max_price", "min_rating"]


def postings(products: DataFrame) -> DataFrame:
    """(term, product_id, weight, by_length, length, level, price, rating) of active products, one row per term and product.

    A field in which the term occurs tf times adds its weight times tf / (tf + 1); `length` counts the words of all
    fields, and by_length is the weight over 1 + ln(1 + length). Both are in millionths. `level` puts the postings of
    a term into blocks of similar weight, eight to a doubling. Meant to be stored with the catalogue and read by many
    searches; nothing in a row depends on other products.
    """
    active = active_products(products).withColumn("length", sum((F.size(word_list(F.col(f))) for f in FIELD_WEIGHTS), F.lit(0)))
    fields = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), F.col(f).alias("text")) for i, f in enumerate(FIELD_WEIGHTS)]))
    texts = active.select(F.col("id").alias("product_id"), "price", "rating", "length", fields.alias("f")).select(
        "product_id", "price", "rating", "length", "f.field", "f.text")
    words = exploded_terms(texts, ["product_id", "price", "rating", "length", "field"], "text", distinct=False)
    counted = words.groupBy("term", "product_id").agg(
        F.first("price").alias("price"), F.first("rating").alias("rating"), F.first("length").alias("length"),
        *[F.count(F.when(F.col("field") == i, True)).alias(f"_{i}") for i in range(len(FIELD_WEIGHTS))])
    parts = [F.expr(f"({UNIT // 10 * w} * _{i}) div (_{i} + 1)") for i, w in enumerate(FIELD_WEIGHTS.values())]
    weighed = counted.withColumn("weight", sum(parts[1:], parts[0]))
    return weighed.select(
        "term", "product_id", "weight", F.floor(F.col("weight") / (1 + F.ln(1 + F.col("length")))).cast("long").alias("by_length"),
        "length", F.floor(8 * F.log2(F.col("weight") + 1)).cast("int").alias("level"), "price", "rating")


def term_blocks(index: DataFrame) -> DataFrame:
    """(term, level, n, top, top_by_length, and the extremes of price and rating) of the blocks of postings."""
    return index.groupBy("term", "level").agg(
        F.count("*").alias("n"), F.max("weight").alias("top"), F.max("by_length").alias("top_by_length"),
        F.min("price").cast("double").alias("_low"), F.max("price").cast("double").alias("_high"),
        F.max("rating").cast("double").alias("_best"))


def within_bounds(price: Column, rating: Column) -> Column:
    lo, hi, stars = F.col("min_price"), F.col("max_price"), F.col("min_rating")
    return ((lo.isNull() | F.coalesce(price >= lo, F.lit(False)))
            & (hi.isNull() | F.coalesce(price <= hi, F.lit(False)))
            & (stars.isNull() | F.coalesce(rating >= stars, F.lit(False))))


def _frequencies(hits: DataFrame, key: str) -> DataFrame:
    """Rows per key, and the pieces they are dealt to."""
    return hits.groupBy(key).agg(F.count("*").alias("df"), F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("_pieces"))


def _dealt(hits: DataFrame, frequencies: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with the piece of their key that they belong to."""
    return hits.join(frequencies.select(key, "_pieces"), key).withColumn(
        "_piece", F.pmod(F.xxhash64(by), F.col("_pieces")).cast("int")).drop("_pieces")


def _to_all_pieces(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "min_price", "max_price", "min_rating").join(
        term_sets(queries, "query_id", "query"), "query_id")


def _hold_all(candidates: DataFrame, hits: DataFrame, weight: str) -> DataFrame:
    """(query_id, id, score) of candidates (query_id, product_id, terms) that hold every term of their query."""
    each = candidates.select("query_id", "product_id", F.size("terms").alias("_n"), F.explode("terms").alias("term"))
    return (
        each.join(hits.select("term", "product_id", weight), ["term", "product_id"])
        .groupBy("query_id", "product_id").agg(
            F.count("*").alias("_found"), F.first("_n").alias("_n"), F.sum(weight).alias("_w"))
        .filter("_found = _n")
        .select("query_id", F.col("product_id").alias("id"), (F.col("_w") / UNIT).alias("score"))
    )


def full_text_matches(queries: DataFrame, index: DataFrame, by_length: bool = False) -> DataFrame:
    """(query_id, id, score) for all products that hold every term of the query and meet its bounds.

    Candidates come from the rarest term of each query only, then the other terms are
    checked by (term, product). Postings of hot terms are split over as many pieces as their count asks for.
    """
    wanted = _terms(queries)
    needed = wanted.select(F.explode("terms").alias("term")).distinct()
    # Read three times below: for frequencies, for candidates and for the check.
    hits = materialise(index.join(needed, "term", "left_semi"), "hits")
    df = materialise(_frequencies(hits, "term"), "frequencies")
    rarest = (
        wanted.select("query_id", F.explode("terms").alias("term")).join(df, "term", "left")
        .groupBy("query_id").agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "_pieces")).alias("_r"))
        .filter("_r.df > 0").select("query_id", F.col("_r.term").alias("term"), "_r._pieces")
    )
    spread = _dealt(hits, df, "term", "product_id")
    asked = wanted.join(_to_all_pieces(rarest), "query_id")
    candidates = asked.join(spread.select("term", "_piece", "product_id", "price", "rating"), ["term", "_piece"]).filter(
        within_bounds(F.col("price"), F.col("rating")))
    return _hold_all(candidates, hits, "by_length" if by_length else "weight")


def _block_plan(wanted: DataFrame, blocks: DataFrame, k: int, by_length: bool) -> DataFrame:
    """(query_id, term, level, n, _ub, _first): the blocks of each query's rarest term, best first.

    _ub bounds the score of every product in the block: the block's highest weight and those of the query's other terms.
    The first blocks that hold FIRST_ROWS postings (k at least) are marked. Queries with a term nobody holds have none;
    blocks outside the bounds of price and rating are left out.
    """
    top = "top_by_length" if by_length else "top"
    lo, hi, stars = F.col("min_price"), F.col("max_price"), F.col("min_rating")
    holds = lambda c: F.coalesce(c, F.lit(False))
    meets = ((lo.isNull() | holds(F.col("_high") >= lo)) & (hi.isNull() | holds(F.col("_low") <= hi))
             & (stars.isNull() | holds(F.col("_best") >= stars)))
    whole = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(top).alias("_most"))
    rarest = (
        wanted.select("query_id", *REQUEST[1:], F.explode("terms").alias("term")).join(whole, "term", "left")
        .groupBy("query_id", *REQUEST[1:]).agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "_most")).alias("_r"), F.sum("_most").alias("_all"))
        .filter("_r.df > 0").select("query_id", *REQUEST[1:], F.col("_r.term").alias("term"),
                                    (F.col("_all") - F.col("_r._most")).alias("_others")))
    plan = rarest.join(blocks, "term").filter(meets).withColumn("_ub", F.col(top) + F.col("_others"))
    before = F.sum("n").over(W.partitionBy("query_id").orderBy(F.col("_ub").desc(), "level").rowsBetween(
        W.unboundedPreceding, -1))
    return plan.select("query_id", "term", "level", "n", "_ub",
                       (F.coalesce(before, F.lit(0)) < max(k, FIRST_ROWS)).alias("_first"))


def _in_blocks(plan: DataFrame, wanted: DataFrame, hits: DataFrame, weight: str) -> DataFrame:
    """Matches among the postings of the planned blocks; large blocks are dealt to pieces."""
    sizes = plan.groupBy("term", "level").agg(F.ceil(F.max("n") / PIECE_ROWS).cast("int").alias("_pieces"))
    spread = hits.join(sizes, ["term", "level"]).withColumn("_piece", F.pmod(F.xxhash64("product_id"), "_pieces").cast("int"))
    asked = _to_all_pieces(plan.select("query_id", "term", "level", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("_pieces")))
    candidates = asked.join(wanted, "query_id").join(
        spread.select("term", "level", "_piece", "product_id", "price", "rating"), ["term", "level", "_piece"]).filter(
        within_bounds(F.col("price"), F.col("rating")))
    return _hold_all(candidates, hits, weight)


def _cells() -> list[Column]:
    """Coarse and fine cells of price and rating: half and 1/64 of a doubling, whole and tenths of a star."""
    price, rating = F.col("price"), F.col("rating")
    doublings = F.log2(F.greatest(price, F.lit(0.5)) + 1)
    coarse = lambda c, v: F.when(c.isNotNull(), F.floor(v)).otherwise(-1).cast("int")
    return [coarse(price, doublings * 2).alias("_p"), coarse(rating, rating).alias("_r"),
            (coarse(price, doublings * 64) * 1000 + coarse(rating, rating * 10)).alias("_f")]


def _price_cell(null: Column, price: Column) -> Column:
    """A cell of price, 1/64 of a doubling; cells keep the order of prices, missing ones come first."""
    doublings = F.log2(F.greatest(price, F.lit(0.5)) + 1)
    return F.when(null, -1).otherwise(F.least(doublings * 64, F.lit(70_000.0)).cast("int"))


def _rating_levels(rows: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
    """(group, _value, _rated, _at): the number of a rating among the group's ratings (_rated = 1), and that of the first
    one that a requested rating allows (_rated = 0). Windows see the distinct ratings of a group, tenths of stars."""
    values = rows.select(*group, F.col("rating").alias("_value"), F.lit(1).alias("_rated")).unionByName(
        asked.select(*group, F.col("min_rating").alias("_value"), F.lit(0).alias("_rated")))
    so_far = W.partitionBy(*group).orderBy("_value", "_rated").rowsBetween(W.unboundedPreceding, 0)
    return values.filter("_value IS NOT NULL").distinct().withColumn(
        "_at", F.sum("_rated").over(so_far) - F.col("_rated"))


def _cheapest_in_bounds(queries: DataFrame, rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """(query_id, id, rank): the n cheapest rows, ties by id, of each query's group within its bounds.

    In price order the rows from a lowest price on follow each other, so a request takes n ranks after its place and
    the highest price cuts them afterwards. Ratings from a lowest one on are the disjoint nodes of a binary tree over
    the group's ratings, at most one a level; a row belongs to one node a level and to the node of all, -1. Of equal
    price only n rows of a node can be first. Places are counted within cells of price and over the cells, so no
    window holds a whole group, and a request costs n rows a node however many rows or requests its group has.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    known = " AND ".join(f"{g} IS NOT NULL" for g in group)
    rows = rows.select(*group, "id", number("price"), number("rating")).filter(known)
    asked = queries.select("query_id", *group, *[number(c) for c in ("min_price", "max_price", "min_rating")]).filter(known)
    firsts = materialise(top_k(rows, [*group, "price", "rating"], [F.col("id")], n, "_turn").drop("_turn"), "bounded-rows")
    levels = materialise(_rating_levels(firsts, asked, group), "rating-levels")
    deep = (levels.filter("_rated = 1").agg(F.max("_at")).first()[0] or 0).bit_length()  # one number
    node = lambda level, at: F.lit(level << 40) + at
    root = F.lit(-1).cast("bigint")

    # A request without a lowest price starts before the rows without a price, or after them if it has a highest one.
    request = [*group, "_null", "_price", "_any", "_stars"]
    lo, hi, stars = (F.col(c) for c in ("min_price", "max_price", "min_rating"))
    is_open = lo.isNull() & hi.isNull()
    asked = asked.select(
        "query_id", *group, is_open.alias("_null"),
        F.when(is_open, 0.0).otherwise(F.coalesce(lo, F.lit(float("-inf")))).alias("_price"),
        stars.isNull().alias("_any"), F.coalesce(stars, F.lit(0.0)).alias("_stars"), "max_price")
    allowed = levels.filter("_rated = 0").select(*group, F.col("_value").alias("_stars"), F.lit(False).alias("_any"), "_at")
    at = F.col("_at")
    suffix = [F.when(F.shiftright(at + ((1 << i) - 1), i) % 2 == 1, node(i, F.shiftright(at + ((1 << i) - 1), i))) for i in range(deep)]
    whole = F.when(at == 0, node(deep, F.lit(0)))
    nodes = F.when(F.col("_any"), F.array(root)).otherwise(F.array_compact(F.array(*suffix, whole)))
    wants = materialise(asked.select(*request).distinct().join(allowed, [*group, "_stars", "_any"], "left").select(
        *request, F.explode(nodes).alias("_node")), "bounded-requests")

    rated = levels.filter("_rated = 1").select(*group, F.col("_value").alias("rating"), "_at")
    own = F.when(at.isNull(), F.array(root)).otherwise(F.array(root, *[node(i, F.shiftright(at, i)) for i in range(deep + 1)]))
    place, point = [*group, "_node"], [*group, "_node", "_null", "_price"]
    held = firsts.join(rated, [*group, "rating"], "left").select(
        *group, F.explode(own).alias("_node"), F.col("price").isNull().alias("_null"),
        F.coalesce("price", F.lit(0.0)).alias("_price"), "id").join(wants.select(*place).distinct(), place, "left_semi")
    held = materialise(top_k(held, point, [F.col("id")], n, "_turn"), "bounded-nodes")

    points = wants.select(*point).distinct().select(*point, F.lit(0).alias("_rows"), F.lit(0).cast("bigint").alias("_n"))
    prices = held.groupBy(*point).agg(F.lit(1).alias("_rows"), F.count("*").alias("_n"))
    both = points.unionByName(prices).withColumn("_cell", _price_cell(F.col("_null"), F.col("_price")))
    inner = W.partitionBy(*place, "_cell").orderBy(F.col("_null").desc(), "_price", "_rows").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*place).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = both.groupBy(*place, "_cell").agg(F.sum("_n").alias("_n")).select(
        *place, "_cell", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_n").over(inner), F.lit(0))
    placed = materialise(both.withColumn("_at", within).join(cells, [*place, "_cell"]).select(
        *point, "_rows", (F.col("_at") + F.col("_before")).alias("_at")), "bounded-places")

    # Rows are listed once for each place that is asked for, then once for each request; lists hold n rows.
    starts = placed.filter("_rows = 0").drop("_rows")
    rank = F.col("_at") + F.col("_turn")
    row = F.struct(F.when(~F.col("_null"), F.col("_price")).alias("price"), "id")
    lists = held.join(placed.filter("_rows = 1"), point).select(
        *place, row.alias("_row"), F.explode(F.sequence(F.greatest(rank - n, F.lit(0)), rank - 1)).alias("_at")).join(
        starts.select(*place, "_at").distinct(), [*place, "_at"], "left_semi").groupBy(*place, "_at").agg(
        F.collect_list("_row").alias("_list"))
    found = wants.join(starts, point).join(lists, [*place, "_at"]).groupBy(*request).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_list"))), 1, n).alias("_list"))
    met = F.filter("_list", lambda x: hi.isNull() | F.coalesce(x["price"] <= hi, F.lit(False)))
    return asked.join(found, request).select("query_id", F.posexplode(met).alias("_at", "_row")).select(
        "query_id", F.col("_row.id").alias("id"), (F.col("_at") + 1).alias("rank"))


def first_in_bounds(queries: DataFrame, rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """(query_id, id, rank): the first n rows, in the given order, of each query's group within its bounds.

    Neither a popular group nor many requests for it multiply: rows fall into cells of price and rating, of which
    the extremes are known. A cell that lies within a request's bounds offers its own first n rows, one outside
    none. A cell on a border is looked at again in finer cells, and only fine cells on a border give all their rows,
    in pieces of PIECE_ROWS. A request without bounds takes the first n of its group. Equal requests are one. The order
    by price and id needs no cells (see `_cheapest_in_bounds`).
    """
    if [str(c) for c in order] == [str(F.col("price")), str(F.col("id"))]:
        return _cheapest_in_bounds(queries, rows, group, n)
    bounds = ["min_price", "max_price", "min_rating"]
    numbers = [F.col(c).cast("double").alias(c) for c in ("price", "rating")]
    rows = rows.select(*group, "id", *numbers).filter(" AND ".join(f"{g} IS NOT NULL" for g in group))
    rows = materialise(rows.select("*", *_cells()), "bounded-rows")
    coarse, fine = [*group, "_p", "_r"], [*group, "_p", "_r", "_f"]

    def extremes(keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.min("price").alias("_low"), F.max("price").alias("_high"), F.min("rating").alias("_worst"),
            F.max("rating").alias("_best"), F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("_pieces"))

    holds = lambda c: F.coalesce(c, F.lit(False))
    lo, hi, stars = (F.col(b) for b in bounds)
    inside = ((lo.isNull() | holds(F.col("_low") >= lo)) & (hi.isNull() | holds(F.col("_high") <= hi))
              & (stars.isNull() | holds(F.col("_worst") >= stars)))
    meets = ((lo.isNull() | holds(F.col("_high") >= lo)) & (hi.isNull() | holds(F.col("_low") <= hi))
             & (stars.isNull() | holds(F.col("_best") >= stars)))

    def heads(asked: DataFrame, keys: list[str]) -> DataFrame:
        first = top_k(rows, keys, order, n, "_head")
        return asked.select("query_id", *keys).join(first.select(*keys, "id", "price", "rating"), keys)

    def search(asked: DataFrame) -> DataFrame:
        cols = ["query_id", "id", "price", "rating"]
        free = lo.isNull() & hi.isNull() & stars.isNull()
        hits = heads(asked.filter(free), group).select(*cols)
        wide = asked.filter(~free).join(extremes(coarse), group).filter(meets)
        hits = hits.unionByName(heads(wide.filter(inside), coarse).select(*cols))
        near = wide.filter(~inside).select("query_id", *bounds, *coarse).join(extremes(fine), coarse).filter(meets)
        hits = hits.unionByName(heads(near.filter(inside), fine).select(*cols))
        border = near.filter(~inside).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        dealt = rows.join(extremes(fine).select(*fine, "_pieces"), fine).withColumn(
            "_piece", F.pmod(F.xxhash64("id"), F.col("_pieces")).cast("int")).drop("_pieces")
        hits = hits.unionByName(border.select("query_id", *bounds, *fine, "_piece").join(dealt, [*fine, "_piece"]).filter(
            within_bounds(F.col("price"), F.col("rating"))).select(*cols))
        return top_k(hits, ["query_id"], order, n).select("query_id", "id", "rank")

    return share_equal(queries.select("query_id", *group, *bounds), [*group, *bounds], search)


def full_text_search(queries: DataFrame, index: DataFrame | SearchIndex, k: int, blocks: DataFrame | None = None,
                     by_length: bool = False) -> DataFrame:
    """(query_id, id, score, rank): best k products per query by weighted term frequency, ties by id.

    `blocks` are the stored `term_blocks` of the postings. The rarest term of a query offers its blocks of postings from
    the best on; once k matches are known, only blocks that can still reach the k-th score are joined.
    """
    spark = queries.sparkSession
    if isinstance(index, SearchIndex):
        index, blocks = index.postings(spark), index.blocks(spark)
    return share_equal(queries, REQUEST, lambda distinct: _best_matches(distinct, index, k, blocks, by_length))


def _second_blocks(plan: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The other blocks whose bound is not below the k-th score found."""
    kth = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_kth")).filter(F.col("_n") >= k)
    return plan.filter(~F.col("_first")).join(kth, "query_id", "left").filter(
        F.col("_kth").isNull() | (F.col("_ub") / UNIT >= F.col("_kth"))).select(*plan.columns)


def _best_matches(queries: DataFrame, index: DataFrame, k: int, blocks: DataFrame | None = None,
                  by_length: bool = False) -> DataFrame:
    weight, order = "by_length" if by_length else "weight", [F.col("score").desc(), F.col("id")]
    wanted = materialise(_terms(queries), "wanted")
    needed = wanted.select(F.explode("terms").alias("term")).distinct()
    hits = materialise(index.join(needed, "term", "left_semi"), "hits")
    blocks = term_blocks(hits) if blocks is None else blocks.join(needed, "term", "left_semi")
    plan = materialise(_block_plan(wanted, blocks, k, by_length), "blocks")
    first = top_k(_in_blocks(plan.filter("_first"), wanted, hits, weight), ["query_id"], order, k)
    if plan.filter("NOT _first").isEmpty():
        return first
    first = materialise(first, "first-matches")
    second = materialise(_second_blocks(plan, first, k), "second-blocks")
    if second.isEmpty():
        return first
    more = _in_blocks(second, wanted, hits, weight).unionByName(first.drop("rank"))
    return top_k(more, ["query_id"], order, k)


def _pieces(text: Column, n: int) -> Column:
    """Distinct n-letter pieces of a text."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))))


def like_matches(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, id): active products whose name, description or brand contains the query text (see `_like_matches`).

    Equal requests are searched once. Their queries and their products travel in lists of some REQUEST_ROWS and PRODUCT_ROWS,
    and become rows where they are read. There each query takes LIST_IDS products at a time, so that files hold the same few
    ids again and again and pack well. No task makes more than some TASK_MATCHES rows.
    """
    keyed = queries.filter("query_id IS NOT NULL").select(
        "query_id", *REQUEST, F.sha2(F.to_json(F.struct(*REQUEST)), 256).alias("_request"))
    counts = materialise(keyed.groupBy("_request").agg(*[F.first(c).alias(c) for c in REQUEST], F.count("*").alias("_n")), "requests")
    found = materialise(_like_matches(counts.select(F.col("_request").alias("query_id"), *REQUEST), products).withColumnRenamed(
        "query_id", "_request"), "substring-matches")
    hits = materialise(found.groupBy("_request").agg(F.count("*").alias("_hits")), "substring-match-counts")
    rows = counts.join(hits, "_request").agg(F.sum(F.col("_n").cast("double") * F.col("_hits"))).first()[0] or 0  # one number

    def lists(part: DataFrame, size: DataFrame, value: str, most: int) -> DataFrame:
        """(_request, _piece, values): the values of each request in sorted lists."""
        pieces = size.select("_request", F.ceil(F.col(size.columns[-1]) / most).cast("int").alias("_pieces"))
        return part.select("_request", value).join(pieces, "_request").groupBy(
            "_request", F.pmod(F.xxhash64(value), F.col("_pieces")).cast("int").alias("_piece")).agg(
            F.sort_array(F.collect_list(value)).alias("_values"))

    asked = lists(keyed.join(hits, "_request", "left_semi"), counts, "query_id", REQUEST_ROWS)
    offered = lists(found, hits, "id", PRODUCT_ROWS).select("_request", F.col("_piece").alias("_part"), F.col("_values").alias("_ids"))
    blocks = asked.join(offered, "_request").repartition(max(1, math.ceil(rows / TASK_MATCHES)), "_request", "_piece", "_part")
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(LIST_IDS))
    few = blocks.select("_values", F.explode(F.transform(starts, lambda at: F.slice("_ids", at, LIST_IDS))).alias("_ids"))
    return few.select(F.explode("_values").alias("query_id"), "_ids").select("query_id", F.explode("_ids").alias("id"))


def _like_matches(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, id): active products whose name, description or brand contains the query text.

    `%` and `_` in the query are wildcards, `\\` escapes. The literal runs of a query are cut into three-letter
    pieces (a query without such a run gives its longest run, of two letters, one or none). Products offer
    their pieces of the lengths that are asked for; candidates come from the rarest piece of a query, counted
    first, and the pattern decides. Pieces that very many products hold are split by count. Queries of
    wildcards only match every product, and meet them under the empty piece.
    """
    low = F.lower(F.coalesce("query", F.lit("")))
    runs = F.split(low, r"\\.|[%_\\]")
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))), -1)
    literal = F.regexp_replace(low, r"\\([^%_\\])", "$1")
    empty = F.array().cast("array<string>")
    threes = F.flatten(F.transform(runs, lambda r: F.coalesce(_pieces(r, 3), empty)))
    asked = queries.select(
        "query_id", "min_price", "max_price", "min_rating", F.concat(F.lit("%"), literal, F.lit("%")).alias("_pattern"),
        F.when(F.size(threes) > 0, F.array_distinct(threes)).otherwise(F.array(longest["r"])).alias("_keys"))
    asked = materialise(asked, "substring-queries")
    wanted = asked.select(F.explode("_keys").alias("_key")).distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("_key")).distinct().collect())  # of 0 to 3
    offered = active_products(products).select(
        "id", "price", "rating", *[F.lower(c).alias(c) for c in LIKE_FIELDS])
    keys = F.concat(*([F.array(F.lit(""))] if 0 in lengths else []), empty, *[
        F.coalesce(_pieces(F.col(c), n), empty) for c in LIKE_FIELDS for n in lengths if n])
    # Only pieces some query asks for are kept, before the product columns travel any further.
    hits = materialise(offered.select("id", F.explode(F.array_distinct(keys)).alias("_key")).join(
        wanted, "_key", "left_semi"), "substring-hits")
    df = materialise(_frequencies(hits, "_key"), "substring-frequencies")
    rarest = (
        asked.select("query_id", F.explode("_keys").alias("_key")).join(df, "_key", "left").groupBy("query_id").agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "_key", "_pieces")).alias("_r"))
        .filter("_r.df > 0").select("query_id", F.col("_r._key").alias("_key"), "_r._pieces"))
    meeting = asked.drop("_keys").join(_to_all_pieces(rarest), "query_id").join(
        _dealt(hits, df, "_key", "id"), ["_key", "_piece"])
    matched = F.lit(False)
    for c in LIKE_FIELDS:
        matched = matched | F.coalesce(F.expr(f"{c} LIKE _pattern"), F.lit(False))
    return (
        meeting.join(offered, "id")
        .filter(matched & within_bounds(F.col("price"), F.col("rating")))
        .select("query_id", "id")
    )


def check_bounds(queries: DataFrame) -> DataFrame:
    """Queries whose minimum price is above the maximum are refused by raising when read."""
    bad = F.col("min_price") > F.col("max_price")
    return queries.withColumn("min_price", F.when(bad, F.raise_error(F.lit(
        "minimum price is above maximum price")).cast(queries.schema["min_price"].dataType)).otherwise(F.col("min_price")))


def product_search(queries: DataFrame, products: DataFrame, k: int,
                   index: DataFrame | SearchIndex | None = None) -> DataFrame:
    """(query_id, id, score, rank): full-text search; queries it finds nothing for fall back to substrings.

    `index` is the stored `SearchIndex` or `postings` of the products; without it they are tokenised anew.
    """
    index, blocks = postings(products) if index is None else index, None
    if isinstance(index, SearchIndex):
        index, blocks = index.postings(queries.sparkSession), index.blocks(queries.sparkSession)
    return share_equal(check_bounds(queries), REQUEST,
                       lambda distinct: _product_search(distinct, products, k, index, blocks))


def _product_search(queries: DataFrame, products: DataFrame, k: int, index: DataFrame, blocks: DataFrame | None) -> DataFrame:
    found = materialise(_best_matches(queries, index, k, blocks).select(
        "query_id", "id", (F.col("score") * 1.0).cast("double").alias("score"), "rank"), "found")
    missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    fallback = top_k(_like_matches(missed, products).withColumn("score", F.lit(0.0)), ["query_id"], [F.col("id")], k)
    return found.unionByName(fallback.select("query_id", "id", "score", "rank"))


def expand_category_names(names: DataFrame, categories: DataFrame) -> DataFrame:
    """(requested, category_name): each requested name with the names it stands for.

    The name itself always; an exact category adds its active descendants; otherwise, for
    names of four letters or more, the first three categories (by name) containing it, each
    with descendants. Containment candidates meet on the first four letters of the request.
    """
    from .catalog import descendants

    asked = names.select("requested").filter(F.col("requested").isNotNull()).distinct()
    below = descendants(categories).select("ancestor_id", F.col("name").alias("category_name"))
    exact = asked.join(categories.select(F.col("name").alias("requested"), F.col("id").alias("ancestor_id")), "requested")
    loose = asked.join(exact.select("requested"), "requested", "left_anti").filter(F.length("requested") >= 4)
    loose = loose.withColumn("_low", F.lower("requested")).withColumn("_key", F.substring("_low", 1, 4))
    named = categories.filter("active").select(
        F.col("id").alias("ancestor_id"), "name", F.lower("name").alias("_name"),
        F.explode(_pieces(F.lower("name"), 4)).alias("_key"))
    close = top_k(
        loose.join(named, "_key").filter(F.col("_name").contains(F.col("_low"))),
        ["requested"], [F.col("name"), F.col("ancestor_id")], 3)
    matched = exact.select("requested", "ancestor_id").unionByName(close.select("requested", "ancestor_id"))
    return (
        asked.select("requested", F.col("requested").alias("category_name"))
        .unionByName(matched.join(below, "ancestor_id").select("requested", "category_name")).distinct()
    )


def category_id_by_name(names: DataFrame, categories: DataFrame) -> DataFrame:
    """(requested, category_id): the first active category in name order equal to or containing the name.

    Requests shorter than three letters meet on pieces of their own length.
    """
    asked = names.select("requested").filter(F.trim("requested") != "").distinct()
    asked = asked.withColumn("_low", F.lower("requested")).withColumn("_key", F.substring("_low", 1, 3))
    empty = F.array().cast("array<string>")
    low = F.lower("name")
    keys = F.concat(*[F.coalesce(_pieces(low, n), empty) for n in (1, 2, 3)])
    named = categories.filter("active").select("id", "name", low.alias("_name"), F.explode(keys).alias("_key"))
    hits = asked.join(named, "_key").filter(F.col("_name").contains(F.col("_low")))
    return hits.groupBy("requested").agg(F.min(F.struct("name", "id"))["id"].alias("category_id"))


def product_details(requests: DataFrame, products: DataFrame, index: DataFrame | SearchIndex | None = None) -> DataFrame:
    """(request_id, id): the product with the given id, else the best search hit for the name."""
    by_id = requests.filter(F.trim(F.coalesce("product_id", F.lit(""))) != "").join(
        products.select(F.col("id").alias("product_id")), "product_id").select(
        "request_id", F.col("product_id").alias("id"))
    no_bound = F.lit(None).cast("double")
    by_name = requests.filter(
        (F.trim(F.coalesce("product_id", F.lit(""))) == "") & (F.trim(F.coalesce("product_name", F.lit(""))) != "")
    ).select(F.col("request_id").alias("query_id"), F.col("product_name").alias("query"), no_bound.alias("min_price"),
             no_bound.alias("max_price"), no_bound.alias("min_rating"))
    best = product_search(by_name, products, 1, index).select(F.col("query_id").alias("request_id"), "id")
    return by_id.unionByName(best)


def compare_products(requests: DataFrame, products: DataFrame, index: DataFrame | SearchIndex | None = None) -> DataFrame:
    """(compare_id, position, id): the best hit for each listed name, misses dropped, input order kept."""
    names = requests.select("compare_id", F.posexplode("names").alias("position", "query"))
    distinct = names.select("query").distinct()
    no_bound = F.lit(None).cast("double")
    asked = distinct.select(F.col("query").alias("query_id"), "query", no_bound.alias("min_price"),
                            no_bound.alias("max_price"), no_bound.alias("min_rating"))
    best = product_search(asked, products, 1, index).select(F.col("query_id").alias("query"), "id")
    return names.join(best, "query").select("compare_id", "position", "id")
