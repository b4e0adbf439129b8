"""Queries over keyword, vector and hybrid search, and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.terms import STOP_WORDS
from ..operators import catalog as K, hybrid as H, search as S, suggestions as G, vectors as V
from ..session import fresh_path
from ..sources import product_files as PF, vector_store as VS
from ..sources.leaf_index import LeafIndex, build_leaf_index, update_leaf_index
from ..sources.search_index import SearchIndex, build_search_index, update_search_index
from .behaviour import profiles_staged
from .catalogue import case_of, nth_of
from .registry import flat, query, r
from .shapes import Shapes, staged
from .sql import cte

THRESHOLD = 0.2
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def stem(w: str) -> str:
    """SQL for the light stemmer."""
    a = f"regexp_replace({w}, '(ss)es$', '\\1')"
    a = f"regexp_replace({a}, '([a-z][a-z])ies$', '\\1y')"
    a = f"regexp_replace({a}, '([^sui])s$', '\\1')"
    cut = f"regexp_replace({a}, '^(.*[aeiouy].+)(ing|ed)$', '\\1')"
    undoubled = (f"CASE WHEN {cut} <> {a} AND regexp_matches({cut}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') "
                 f"THEN left({cut}, length({cut}) - 1) ELSE {cut} END")
    return f"CASE WHEN length({w}) >= 4 THEN regexp_replace({undoubled}, '^(....+)e$', '\\1') ELSE {w} END"


def term_rows(source: str, text: str, keep: str) -> str:
    """SQL for distinct (keep..., term) of a text column."""
    return (f"SELECT DISTINCT {keep}, {stem('w')} AS term FROM (SELECT {keep}, "
            f"unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) "
            f"WHERE w <> '' AND w NOT IN ({STOPS})")


cte("x_query", """
SELECT 'n-' || p_partkey AS query_id, p_name AS query, NULL::DOUBLE AS min_price,
  CASE WHEN p_type = 'LARGE' THEN 20000.0::DOUBLE END AS max_price, CASE WHEN p_type = 'SMALL' THEN 2.5::DOUBLE END AS min_rating FROM part
UNION ALL SELECT DISTINCT 'b-' || p_brand, substr(p_brand, 2), NULL, NULL, NULL FROM part
UNION ALL SELECT DISTINCT 'w-' || p_name, replace(substr(p_name, 2, length(p_name) - 2), ' ', '%'), 1000, NULL, NULL FROM part
UNION ALL SELECT 'c-' || conv_id || '-' || turn, text, NULL, NULL, NULL FROM conversations WHERE role = 'user'""")


def keyword_queries(s: Shapes) -> DataFrame:
    none = F.lit(None).cast("double")
    part = s.t("part")
    names = part.select(
        F.concat(F.lit("n-"), F.col("p_partkey").cast("string")).alias("query_id"), F.col("p_name").alias("query"),
        none.alias("min_price"), F.when(F.col("p_type") == "LARGE", 20000.0).alias("max_price"),
        F.when(F.col("p_type") == "SMALL", 2.5).alias("min_rating"))
    brands = part.select(F.concat(F.lit("b-"), "p_brand").alias("query_id"), F.expr("substring(p_brand, 2)").alias("query"),
                         none.alias("min_price"), none.alias("max_price"), none.alias("min_rating")).distinct()
    inner = F.expr("replace(substring(p_name, 2, length(p_name) - 2), ' ', '%')")
    wild = part.select(F.concat(F.lit("w-"), "p_name").alias("query_id"), inner.alias("query"),
                       F.lit(1000.0).alias("min_price"), none.alias("max_price"), none.alias("min_rating")).distinct()
    asked = s.t("conversations").filter("role = 'user'").select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"), none.alias("min_price"), none.alias("max_price"), none.alias("min_rating"))
    return names.unionByName(brands).unionByName(wild).unionByName(asked)


FIELDS = (("name", 10), ("category_name", 10), ("brand", 4), ("description", 2))


def term_sql(products: str) -> str:
    """SQL for (id, price, rating, term, weight): millionths of each active product's terms, by frequency in the fields."""
    words = " UNION ALL ".join(
        f"SELECT id, price, rating, {i} AS field, {w} AS field_weight, unnest(regexp_split_to_array(lower(coalesce({c}, '')), "
        f"'[^\\p{{L}}\\p{{N}}]+')) AS w FROM {products} WHERE status = 'ACTIVE'" for i, (c, w) in enumerate(FIELDS))
    counted = (f"SELECT id, any_value(price) AS price, any_value(rating) AS rating, field_weight, {stem('w')} AS term, count(*) AS tf "
               f"FROM ({words}) WHERE w <> '' AND w NOT IN ({STOPS}) GROUP BY id, field, field_weight, term")
    return (f"SELECT id, any_value(price) AS price, any_value(rating) AS rating, term, "
            f"sum((100000 * field_weight * tf) // (tf + 1))::BIGINT AS weight FROM ({counted}) GROUP BY id, term")


cte("x_term", term_sql("x_pc"))


def in_bounds(q: str, p: str) -> str:
    return (f"({q}.min_price IS NULL OR {p}.price >= {q}.min_price) AND ({q}.max_price IS NULL OR {p}.price <= {q}.max_price) "
            f"AND ({q}.min_rating IS NULL OR {p}.rating >= {q}.min_rating)")


def fts_sql(queries: str, terms: str = "x_term") -> str:
    """(query_id, id, score) of full-text matches of a query table."""
    return f"""
SELECT q.query_id, t.id, sum(t.weight) / 1000000.0 AS score
FROM ({term_rows(queries, 'query', 'query_id, min_price, max_price, min_rating')}) q
JOIN {terms} t ON t.term = q.term
JOIN (SELECT query_id, count(*) AS n FROM ({term_rows(queries, 'query', 'query_id')}) GROUP BY 1) c ON c.query_id = q.query_id
WHERE {in_bounds('q', 't')} GROUP BY q.query_id, t.id, n HAVING count(*) = n"""


def like_sql(queries: str) -> str:
    pattern = "'%' || lower(coalesce(q.query, '')) || '%'"
    return f"""
SELECT q.query_id, p.id FROM {queries} q JOIN x_prod p ON p.status = 'ACTIVE' AND (lower(p.name) LIKE {pattern}
  OR lower(p.description) LIKE {pattern} OR lower(p.brand) LIKE {pattern}) AND {in_bounds('q', 'p')}"""


def search_sql(queries: str, k: int) -> str:
    """(query_id, id, score, rank) of full-text search with substring fallback."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  {fts_sql(queries)}
  UNION ALL SELECT query_id, id, 0.0 FROM ({like_sql(queries)}) WHERE query_id NOT IN (SELECT query_id FROM ({fts_sql(queries)}))
) QUALIFY rank <= {k}"""


@query("h1_full_text_search", f"""
SELECT query_id, id, {r('score')}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM ({fts_sql('x_query')}) QUALIFY rank <= 10""")
def h1(s: Shapes) -> DataFrame:
    df = S.full_text_search(keyword_queries(s), s.search_index(), 10)
    return flat(df.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank"))


cte("x_len", f"""
SELECT id, count(*) AS length FROM ({" UNION ALL ".join(
    f"SELECT id, unnest(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM x_pc" for c, _ in FIELDS)})
WHERE w <> '' AND w NOT IN ({STOPS}) GROUP BY id""")
cte("x_term_by_length", """
SELECT t.id, price, rating, term, floor(weight / (1 + ln(1 + length)))::BIGINT AS weight FROM x_term t JOIN x_len USING (id)""")


@query("h1_full_text_by_length", f"""
SELECT query_id, id, {r('score')}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM ({fts_sql('x_query', 'x_term_by_length')}) QUALIFY rank <= 5""")
def h1_by_length(s: Shapes) -> DataFrame:
    """Weights over the length of the product's texts."""
    df = S.full_text_search(keyword_queries(s), s.search_index(), 5, by_length=True)
    return flat(df.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank"))


RENAMED = """SELECT id, CASE WHEN name LIKE '%a%' THEN name || ' ' || brand || ' ' || brand ELSE name END AS name,
  CASE WHEN category_name LIKE '%s' THEN 'Renamed ' || category_name ELSE category_name END AS category_name, brand, description,
  price, rating, CASE WHEN price < 3000 THEN 'GONE' ELSE status END AS status FROM x_pc"""
cte("x_renamed", RENAMED)
cte("x_term_renamed", term_sql("x_renamed"))


def changed_search_index(s: Shapes) -> SearchIndex:
    """Three batches: some names grow, categories change their names, cheap products leave."""
    whole = s.catalog().select("id", "name", "category_name", "brand", "description", "price", "rating", "status")
    grown = whole.filter("name LIKE '%a%'").withColumn("name", F.concat_ws(" ", "name", "brand", "brand"))
    named = F.concat(F.lit("Renamed "), "category_name")
    moved = whole.join(grown.select("id"), "id", "left_anti").unionByName(grown).filter(
        "category_name LIKE '%s'").withColumn("category_name", named)
    index = update_search_index(s.spark, build_search_index(whole), grown)
    index = update_search_index(s.spark, index, moved)
    return update_search_index(s.spark, index, whole.limit(0), whole.filter("price < 3000").select("id"))


@query("h1_index_after_changes", "SELECT id, term, weight FROM x_term_renamed")
def h1_changed(s: Shapes) -> DataFrame:
    """The live postings of an index after three batches of changes."""
    return changed_search_index(s).postings(s.spark).select(F.col("product_id").alias("id"), "term", "weight")


@query("h1_search_after_changes", f"""
SELECT query_id, id, {r('score')}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM ({fts_sql('x_query', 'x_term_renamed')}) QUALIFY rank <= 10""")
def h1_search_changed(s: Shapes) -> DataFrame:
    df = S.full_text_search(keyword_queries(s), changed_search_index(s), 10)
    return flat(df.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank"))


@query("h1_full_text_documents", f"""
SELECT item_id, doc_id FROM (
  SELECT q.item_id, d.doc_id, n FROM ({term_rows('benchmark', 'text', 'item_id')}) q
  JOIN (SELECT item_id, count(*) AS n FROM ({term_rows('benchmark', 'text', 'item_id')}) GROUP BY 1) c ON c.item_id = q.item_id
  JOIN ({term_rows('documents', 'text', 'doc_id')}) d ON d.term = q.term
) GROUP BY item_id, doc_id, n HAVING count(*) = n""")
def h1_documents(s: Shapes) -> DataFrame:
    """Documents that hold every word of a benchmark passage, over whole texts."""
    none = F.lit(None).cast("double")
    docs = s.t("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("").alias("name"), F.lit("").alias("category_name"),
        F.lit("").alias("brand"), F.col("text").alias("description"), F.lit("ACTIVE").alias("status"),
        none.alias("price"), none.alias("rating"))
    asked = s.t("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"),
                                    none.alias("min_price"), none.alias("max_price"), none.alias("min_rating"))
    found = S.full_text_matches(asked, S.postings(docs))
    return found.select(F.col("query_id").cast("bigint").alias("item_id"), F.col("id").cast("bigint").alias("doc_id"))


@query("h2_like_search", like_sql("x_query"))
def h2(s: Shapes) -> DataFrame:
    return S.like_matches(keyword_queries(s), s.products())


@query("h2_product_search_fallback", f"SELECT query_id, id, {r('score')}, rank FROM ({search_sql('x_query', 10)})")
def h2_fallback(s: Shapes) -> DataFrame:
    return flat(S.product_search(keyword_queries(s), s.catalog(), 10, s.search_index()).select("query_id", "id", "score", "rank"))


cte("x_req", """
SELECT DISTINCT p_type AS requested FROM part UNION SELECT substr(p_type, 1, 4) FROM part
UNION SELECT substr(p_name, 2) FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part
UNION SELECT substr(split_part(p_name, ' ', -1), 2) FROM part UNION SELECT substr(p_type, 1, 2) FROM part
UNION SELECT 'Catalog' FROM part""")


def requested_names(s: Shapes) -> DataFrame:
    leaf = "element_at(split(p_name, ' '), -1)"
    return s.t("part").select(F.explode(F.expr(
        f"array(p_type, substring(p_type, 1, 4), substring(p_name, 2), {leaf}, substring({leaf}, 2), "
        "substring(p_type, 1, 2), 'Catalog')")).alias("requested")).distinct()


EXPAND = """
SELECT requested, requested AS category_name FROM x_req UNION
SELECT m.requested, d.name FROM (
  SELECT r.requested, c.path FROM x_req r JOIN x_cat c ON c.name = r.requested
  UNION ALL SELECT requested, path FROM (
    SELECT r.requested, c.path FROM x_req r JOIN x_cat c ON contains(lower(c.name), lower(r.requested))
    WHERE length(r.requested) >= 4 AND r.requested NOT IN (SELECT name FROM x_cat)
    QUALIFY row_number() OVER (PARTITION BY r.requested ORDER BY c.name, c.id) <= 3)) m
JOIN x_cat d ON d.path = m.path OR starts_with(d.path, m.path || ' >> ')"""
cte("x_expand", EXPAND)


@query("h4_expand_category_names", "SELECT requested, category_name FROM x_expand")
def h4(s: Shapes) -> DataFrame:
    return S.expand_category_names(requested_names(s), s.categories())


RELATED_CASES = [("Running Shoes", "footwear"), ("Boots", "footwear"), ("On-Ear", "audio"), ("Wireless Headphones", "audio"),
                 ("Blouses", "tops"), ("Shirts & Tees", "tops"), ("jeans", "bottoms"), ("Sweatpants", "bottoms"), ("Garden", None)]


@query("h4b_related_categories", "SELECT p_partkey, " + case_of("p_partkey", [
    "" if domain is None else "|".join(H.CATEGORY_DOMAINS[domain]) for _, domain in RELATED_CASES]) + " AS related FROM part")
def h4b(s: Shapes) -> DataFrame:
    asked = s.t("part").select("p_partkey", nth_of("p_partkey", [name for name, _ in RELATED_CASES]).alias("asked"))
    return flat(asked.select("p_partkey", H.related_categories("asked").alias("related")))


@query("h4c_category_id_by_name", """
SELECT requested, id AS category_id FROM x_req JOIN x_cat ON contains(lower(name), lower(requested))
QUALIFY row_number() OVER (PARTITION BY requested ORDER BY name, id) = 1""")
def h4c(s: Shapes) -> DataFrame:
    return S.category_id_by_name(requested_names(s), s.categories())


cte("x_names", "SELECT DISTINCT p_name AS query_id, p_name AS query, NULL::DOUBLE AS min_price, NULL::DOUBLE AS max_price, NULL::DOUBLE AS min_rating FROM part")


@query("h5_product_details", f"""
SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN p_type = 'LARGE' THEN CAST(p_partkey AS VARCHAR) ELSE id END AS id
FROM part JOIN ({search_sql('x_names', 1)}) ON query_id = p_name""")
def h5(s: Shapes) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    asked = s.t("part").select(key.alias("request_id"), F.when(F.col("p_type") == "LARGE", key).alias("product_id"),
                               F.col("p_name").alias("product_name"))
    return S.product_details(asked, s.catalog(), s.search_index())


@query("h5_compare_products", f"""
SELECT compare_id, position, id FROM (
  SELECT p_brand AS compare_id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS position FROM (
    SELECT p_brand, list(DISTINCT p_name ORDER BY p_name) AS names FROM part GROUP BY p_brand))
JOIN ({search_sql('x_names', 1)}) ON query_id = name""")
def h5_compare(s: Shapes) -> DataFrame:
    asked = s.t("part").groupBy(F.col("p_brand").alias("compare_id")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return S.compare_products(asked, s.catalog(), s.search_index())


# ---- vectors ----

cte("x_index", "SELECT p.id, CAST(embedding AS DOUBLE[]) AS v, p.price, p.rating, p.category_id, p.brand FROM embeddings JOIN x_prod p ON p.id = CAST(vec_id AS VARCHAR)")
cte("x_vq", """
SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v, NULL::DOUBLE AS min_price,
  CASE WHEN label = 0 THEN 20000.0 END AS max_price, CASE WHEN label = 1 THEN 2.5 END AS min_rating FROM embeddings""")


cte("x_vqa", "SELECT id AS query_id, v, lower(brand) AS brand FROM x_index")


def vector_sql(queries: str, k: str, where: str = "true") -> str:
    return f"""
SELECT q.query_id, i.id, round(list_cosine_similarity(q.v, i.v), 9) AS similarity,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, i.v), 9) DESC, i.id) AS rank
FROM {queries} q JOIN x_index i ON {where} AND round(list_cosine_similarity(q.v, i.v), 9) >= {THRESHOLD} QUALIFY rank <= {k}"""


@query("v1_vector_search", f"SELECT query_id, id, {r('similarity')}, rank FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i'))})")
def v1(s: Shapes) -> DataFrame:
    return flat(V.vector_search(s.vector_queries(), s.leaf_index(), 10, THRESHOLD))


@query("v1_vector_search_by_leaves", f"SELECT query_id, id, {r('similarity')}, rank FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i'))})")
def v1_leaves(s: Shapes) -> DataFrame:
    """The same search with another number of leaves."""
    return flat(V.vector_search(s.vector_queries(), s.leaf_index(7), 10, THRESHOLD))


@query("v1_vector_search_plain", f"SELECT query_id, id, {r('similarity')}, rank FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i'))})")
def v1_plain(s: Shapes) -> DataFrame:
    """The same search of an index that is not stored yet."""
    return flat(V.vector_search(s.vector_queries(), s.vector_index(), 10, THRESHOLD))


@query("v1_vector_search_allow", f"SELECT query_id, id, rank FROM ({vector_sql('x_vqa', '5', 'q.brand = lower(i.brand)')})")
def v1_allow(s: Shapes) -> DataFrame:
    """Only products of the query's brand."""
    asked = s.vector_index().select(F.col("id").alias("query_id"), "embedding", F.lower("brand").alias("brand"))
    return V.vector_search(asked, s.leaf_index(), 5, THRESHOLD).select("query_id", "id", "rank")


@query("v1b_approximate_search")
def v1b(s: Shapes) -> DataFrame:
    return flat(V.vector_search(s.vector_queries(), s.leaf_index(20), 10, THRESHOLD, share=V.LEAF_SHARE))


@query("v1b_recall", f"""
SELECT count(*) AS exact, 1 AS enough FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i'))})""")
def v1b_recall(s: Shapes) -> DataFrame:
    """Matches of the exact search, and whether three quarters of the leaves find nine tenths of them."""
    keys = ["query_id", "id"]
    exact = V.vector_search(s.vector_queries(), s.leaf_index(), 10, THRESHOLD).select(*keys)
    near = V.vector_search(s.vector_queries(), s.leaf_index(20), 10, THRESHOLD, share=0.75).select(
        *keys, F.lit(1).alias("hit")).distinct()
    both = exact.join(near, keys, "left").agg(F.count("*").alias("exact"), F.count("hit").alias("_hits"))
    return both.select("exact", (F.col("_hits") >= 0.9 * F.col("exact")).cast("int").alias("enough"))


@query("v1b_against_exact", f"""
SELECT query_id, count(*) AS exact, 0 AS wrong FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i'))}) GROUP BY query_id""")
def v1b_against_exact(s: Shapes) -> DataFrame:
    """For each query how many matches the exact search has, and how many of the approximate one beat those of their rank."""
    exact = V.vector_search(s.vector_queries(), s.leaf_index(), 10, THRESHOLD)
    near = V.vector_search(s.vector_queries(), s.leaf_index(20), 10, THRESHOLD, share=V.LEAF_SHARE).select(
        "query_id", "rank", F.col("similarity").alias("near"))
    wrong = F.count(F.when(F.col("near") > F.col("similarity"), True)).cast("int")
    return exact.join(near, ["query_id", "rank"], "left").groupBy("query_id").agg(
        F.count("*").alias("exact"), wrong.alias("wrong"))


cte("x_variant", """
SELECT a.vec_id, b.variant, e.v, a.vec_id || ':' || b.variant AS query_id FROM embeddings a, (VALUES (0), (1), (2)) b(variant)
JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e
  ON e.vec_id = (a.vec_id + b.variant) % (SELECT count(*) FROM embeddings)""")


def variant_rows(s: Shapes) -> DataFrame:
    e = s.t("embeddings")
    n = e.agg(F.count("*")).scalar()
    wanted = e.select(F.col("vec_id").cast("string").alias("query_id"), "vec_id",
                      F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"), n.alias("_n"))
    wanted = wanted.withColumn("_v", (F.col("vec_id") + F.col("variant")) % F.col("_n"))
    return wanted.drop("vec_id").join(e.select(F.col("vec_id").alias("_v"), "embedding"), "_v").select(
        "query_id", "variant", "embedding")


@query("v2_expanded_search", f"""
SELECT CAST(vec_id AS VARCHAR) AS query_id, id, {r('max(similarity)', 'similarity')},
  row_number() OVER (PARTITION BY vec_id ORDER BY max(similarity) DESC, id) AS rank
FROM (SELECT vec_id, id, similarity FROM ({vector_sql('x_variant', '5')}) JOIN x_variant USING (query_id)) GROUP BY vec_id, id QUALIFY rank <= 10""")
def v2(s: Shapes) -> DataFrame:
    return flat(V.expanded_search(variant_rows(s), s.leaf_index(), 10, THRESHOLD))


cte("x_vqi", "SELECT id AS query_id, v FROM x_index")
SIMILAR = f"""
SELECT item_id, id, similarity, fetched, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT f.query_id AS item_id, f.id, f.similarity, f.rank AS fetched FROM ({vector_sql('x_vqi', '{n}')}) f
  JOIN x_pc a ON a.id = f.query_id JOIN x_pc b ON b.id = f.id AND lower(a.category_name) = lower(b.category_name) WHERE f.id <> f.query_id)"""


@query("v3_similar_products", f"SELECT item_id, id, {r('similarity')}, rank FROM ({SIMILAR.replace('{n}', '60')}) WHERE rank <= 20")
def v3(s: Shapes) -> DataFrame:
    items = s.vector_index().select(F.col("id").alias("item_id"))
    return flat(V.similar_products(items, s.leaf_index(), s.catalog(), 20, THRESHOLD))


def prediction_lines(s: Shapes) -> DataFrame:
    values = F.struct(F.struct(F.col("embedding").alias("values")).alias("embeddings"))
    return s.t("embeddings").select(F.to_json(F.struct(
        F.struct(F.col("vec_id").cast("string").alias("id")).alias("instance"),
        F.array(values).alias("predictions"))).alias("value"))


@query("s5_read_embeddings", f"""
SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dims, {r('embedding[1]', 'first')}, {r('embedding[-1]', 'last')} FROM embeddings""")
def s5(s: Shapes) -> DataFrame:
    path = fresh_path(s.spark, "predictions")
    prediction_lines(s).write.text(path)
    df = PF.read_embeddings(s.spark, path)
    return flat(df.select("id", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
                          F.element_at("embedding", -1).cast("double").alias("last")))


@query("j8_e3_embedding_index", f"""
SELECT id, category_id, lower(brand) AS brand, {r('price')}, {r('coalesce(rating, -1)', 'rating')}, len(v) AS dims
FROM x_index WHERE id IN (SELECT id FROM x_prod WHERE status = 'ACTIVE')""")
def e3(s: Shapes) -> DataFrame:
    meta = PF.embedding_input(s.catalog()).select(F.from_json(
        "metadata", "id string, categoryId string, brand string, price double, rating double").alias("m")).select(
        "m.id", F.col("m.categoryId").alias("category_id"), "m.brand", "m.price", "m.rating")
    index = VS.embedding_index(meta, PF.parse_embeddings(prediction_lines(s)))
    return flat(index.select("id", "category_id", "brand", "price", F.coalesce("rating", F.lit(-1.0)).alias("rating"),
                             F.size("embedding").alias("dims")))


@query("e3_datapoints", """
SELECT id, '[{"namespace":"category_id","allow":["' || category_id || '"]},{"namespace":"brand","allow":["' || brand || '"]}]' AS restricts,
  len(v) AS dims FROM x_index""")
def e3_points(s: Shapes) -> DataFrame:
    point = F.from_json("datapoint", "id string, embedding array<double>, restricts array<struct<namespace:string,allow:array<string>>>")
    return VS.datapoints(s.vector_index()).select(point.alias("d")).select(
        "d.id", F.to_json("d.restricts").alias("restricts"), F.size("d.embedding").alias("dims"))


@query("s6_write_vector_index", f"""
SELECT id, CASE WHEN rating >= 2.5 THEN 'delta' ELSE coalesce(brand, '') END AS brand, {r('price')} FROM x_index""")
def s6(s: Shapes) -> DataFrame:
    """A whole index is written, then a delta replaces the well rated products' rows."""
    index = s.vector_index()
    first = VS.write_index(s.spark, index, None, complete_overwrite=True)
    delta = index.filter("rating >= 2.5").withColumn("brand", F.lit("delta"))
    second = VS.write_index(s.spark, delta, first)
    df = s.spark.read.schema(index.schema).parquet(second)
    return flat(df.select("id", F.coalesce("brand", F.lit("")).alias("brand"), F.col("price").cast("double").alias("price")))


CHANGED = """SELECT id, CASE WHEN rating >= 2.5 THEN 'delta' ELSE brand END AS brand, price, rating,
  CASE WHEN rating >= 2.5 THEN list_transform(v, lambda x: -x) ELSE v END AS v, category_id FROM x_index WHERE price >= 2000"""


def changed_index(s: Shapes) -> LeafIndex:
    """Well rated products turn round and change their brand, then the cheap ones leave: two snapshots of a stored index."""
    index = s.vector_index()
    delta = index.filter("rating >= 2.5").withColumns(
        {"brand": F.lit("delta"), "embedding": F.transform("embedding", lambda x: -x)})
    stored = update_leaf_index(s.spark, build_leaf_index(index, leaves=12), delta)
    return update_leaf_index(s.spark, stored, None, index.filter("price < 2000").select("id"))


@query("s6_leaf_index_delta", f"SELECT id, coalesce(lower(brand), '') AS brand, {r('price')}, {r('v[1]', 'first')} FROM ({CHANGED})")
def s6_leaves(s: Shapes) -> DataFrame:
    """The rows of a stored index after a delta and deletes by id; only the leaves they touch are written."""
    return flat(changed_index(s).rows(s.spark).select(
        "id", F.coalesce("brand", F.lit("")).alias("brand"), "price", F.element_at("embedding", 1).cast("double").alias("first")))


cte("x_changed", CHANGED)


@query("v1_vector_search_after_delta", f"SELECT query_id, id, {r('similarity')}, rank FROM ({vector_sql('x_vq', '10', in_bounds('q', 'i')).replace('x_index', 'x_changed')})")
def v1_after_delta(s: Shapes) -> DataFrame:
    """The search of the changed index, new vectors in the leaves of the stored centres."""
    return flat(V.vector_search(s.vector_queries(), changed_index(s), 10, THRESHOLD))


# ---- hybrid ----

cte("x_hq", """
SELECT 'h-' || p_partkey AS query_id, CASE WHEN p_size > 40 THEN NULL ELSE p_name END AS query,
  CASE WHEN p_type IN ('PROMO', 'LARGE', 'STANDARD') THEN CASE WHEN p_size > 25 THEN p_type ELSE split_part(p_name, ' ', -1) END END AS category,
  CASE WHEN p_type IN ('LARGE', 'SMALL') THEN p_brand END AS brand,
  CASE WHEN p_type = 'MEDIUM' THEN 3000.0::DOUBLE END AS min_price,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 30000.0::DOUBLE END AS max_price,
  CASE WHEN p_type = 'SMALL' THEN 2.0::DOUBLE END AS min_rating, CAST(e.embedding AS DOUBLE[]) AS v
FROM part JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings)""")


def hybrid_queries(s: Shapes) -> DataFrame:
    e = s.t("embeddings")
    t, size = F.col("p_type"), F.col("p_size")
    n = e.agg(F.count("*")).scalar()
    asked = s.t("part").select(
        F.concat(F.lit("h-"), F.col("p_partkey").cast("string")).alias("query_id"),
        F.when(size <= 40, F.col("p_name")).alias("query"),
        F.when(t.isin("PROMO", "LARGE", "STANDARD"), F.when(size > 25, t).otherwise(
            F.element_at(F.split("p_name", " "), -1))).alias("category"),
        F.when(t.isin("LARGE", "SMALL"), F.col("p_brand")).alias("brand"),
        F.when(t == "MEDIUM", 3000.0).alias("min_price"), F.when(t.isin("ECONOMY", "LARGE"), 30000.0).alias("max_price"),
        F.when(t == "SMALL", 2.0).alias("min_rating"), (F.col("p_partkey") % n).alias("vec_id"))
    return asked.join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


cte("x_hs", "SELECT * FROM x_hq WHERE query IS NOT NULL OR brand IS NOT NULL")
cte("x_hk", "SELECT query_id, coalesce(brand, query) AS query, min_price, max_price, min_rating FROM x_hs")
cte("x_resolved", """
SELECT requested, id AS category_id FROM (SELECT DISTINCT category AS requested FROM x_hq WHERE category IS NOT NULL)
JOIN x_cat ON contains(lower(name), lower(requested)) QUALIFY row_number() OVER (PARTITION BY requested ORDER BY name, id) = 1""")
cte("x_merged", f"""
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS rank FROM (
  SELECT query_id, id, min((source, rank)) AS o FROM (
    SELECT 0 AS source, q.query_id, p.id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.price, p.id) AS rank
    FROM x_hs q JOIN x_prod p ON lower(p.brand) = lower(q.brand) AND p.status = 'ACTIVE' AND {in_bounds('q', 'p')} QUALIFY rank <= 30
    UNION ALL SELECT 1, query_id, id, rank FROM ({vector_sql('x_hs', '10', in_bounds('q', 'i'))})
    UNION ALL SELECT 2, query_id, id, rank FROM ({search_sql('x_hk', 30)})
    UNION ALL SELECT 3, q.query_id, p.id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.id) AS rank
    FROM x_hs q JOIN x_resolved ON requested = q.category JOIN x_prod p USING (category_id)
    WHERE p.status = 'ACTIVE' AND {in_bounds('q', 'p')} QUALIFY rank <= 30
  ) GROUP BY query_id, id)""")
cte("x_kept", f"""
SELECT m.query_id, m.id, row_number() OVER (PARTITION BY m.query_id ORDER BY CASE WHEN q.max_price IS NOT NULL THEN p.price END
    DESC NULLS LAST, m.rank, m.id) AS rank, q.query, q.max_price,
  p.name || ' by ' || p.brand || '. Category: ' || p.category_name || '. ' || p.description AS content
FROM x_merged m JOIN x_hs q USING (query_id) JOIN x_pc p ON p.id = m.id
WHERE (q.brand IS NULL OR lower(p.brand) = lower(q.brand)) AND {in_bounds('q', 'p')}
  AND (q.category IS NULL OR EXISTS (SELECT 1 FROM x_expand x WHERE x.requested = q.category AND x.category_name = p.category_name))""")
HYBRID = f"""
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, id) AS rank FROM (
  SELECT k.query_id, k.id, k.rank AS before, CASE WHEN n > 10 THEN coalesce(o.score, 0) ELSE 0 END AS score
  FROM x_kept k JOIN (SELECT query_id, count(*) AS n FROM x_kept GROUP BY 1) c ON c.query_id = k.query_id
  LEFT JOIN (SELECT a.query_id, b.id, count(*) AS score
    FROM ({term_rows('x_hs', 'query', 'query_id')}) a
    JOIN (SELECT DISTINCT query_id, id FROM x_kept) k2 ON k2.query_id = a.query_id
    JOIN ({term_rows('(SELECT DISTINCT id, content FROM x_kept)', 'content', 'id')}) b ON b.id = k2.id AND b.term = a.term GROUP BY 1, 2) o
  ON o.query_id = k.query_id AND o.id = k.id
  WHERE k.max_price IS NULL OR k.rank <= 20) QUALIFY rank <= 10"""
BROWSE = f"""
SELECT query_id, id, rank FROM (
  SELECT q.query_id, p.id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.id) AS rank
  FROM x_hq q JOIN x_resolved ON requested = q.category JOIN x_prod p USING (category_id)
  WHERE q.query IS NULL AND q.brand IS NULL AND p.status = 'ACTIVE' AND {in_bounds('q', 'p')} QUALIFY rank <= 10)
UNION ALL SELECT query_id, id, rank FROM (
  SELECT q.query_id, p.id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.id) AS rank, q.min_rating, p.rating
  FROM x_hq q JOIN x_prod p ON p.status = 'ACTIVE' AND p.price BETWEEN coalesce(q.min_price, 0) AND coalesce(q.max_price, 999999)
  WHERE q.query IS NULL AND q.brand IS NULL AND q.category IS NULL AND (q.min_price IS NOT NULL OR q.max_price IS NOT NULL) QUALIFY rank <= 10)
  WHERE min_rating IS NULL OR rating >= min_rating
UNION ALL SELECT q.query_id, p.id, p.rank FROM x_hq q JOIN (
  SELECT id, row_number() OVER (ORDER BY id) AS rank FROM x_prod WHERE status = 'ACTIVE' AND featured QUALIFY rank <= 10) p ON true
  WHERE q.query IS NULL AND q.brand IS NULL AND q.category IS NULL AND q.min_price IS NULL AND q.max_price IS NULL"""


@query("h3_hybrid_search", HYBRID)
def h3(s: Shapes) -> DataFrame:
    return H.hybrid_search(hybrid_queries(s), s.catalog(), s.categories(), s.leaf_index(), THRESHOLD, s.search_index())


@query("h3b_browse_search", BROWSE)
def h3b(s: Shapes) -> DataFrame:
    return H.browse_search(hybrid_queries(s), s.catalog(), s.categories(), s.search_index())


cte("x_bounded", """
SELECT CAST(o_orderkey AS VARCHAR) AS query_id, p_brand AS brand, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 40 END AS min_price,
  CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 10 END AS max_price, CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey % 50) / 10.0 END AS min_rating
FROM orders JOIN part ON p_partkey = 1 + o_orderkey % (SELECT count(*) FROM part)""")


@query("h3_first_in_bounds", f"""
SELECT q.query_id, p.id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.price, p.id) AS rank
FROM x_bounded q JOIN x_prod p ON p.brand = q.brand AND p.status = 'ACTIVE' AND {in_bounds('q', 'p')} QUALIFY rank <= 5""")
def h3_bounded(s: Shapes) -> DataFrame:
    """A request for each order: products of some brand around its price."""
    n, c, total = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    part = s.t("part").select(F.col("p_partkey").alias("_part"), F.col("p_brand").alias("brand"))
    asked = s.t("orders").withColumn("_part", n % part.agg(F.count("*")).scalar() + 1).join(part, "_part").select(
        n.cast("string").alias("query_id"), "brand", F.when(n % 3 > 0, total / 40).alias("min_price"),
        F.when(c % 2 == 0, total / 10).alias("max_price"), F.when(c % 3 == 0, (n % 50) / 10).alias("min_rating"))
    return S.first_in_bounds(asked, K.active_products(s.products()), ["brand"], [F.col("price"), F.col("id")], 5)


@query("h3b_browse_rating_first", BROWSE.replace("QUALIFY rank <= 10)\n  WHERE min_rating IS NULL OR rating >= min_rating", "QUALIFY rank <= 10)").replace(
    "coalesce(q.max_price, 999999)\n", "coalesce(q.max_price, 999999) AND (q.min_rating IS NULL OR p.rating >= q.min_rating)\n"))
def h3b_rating_first(s: Shapes) -> DataFrame:
    return H.browse_search(hybrid_queries(s), s.catalog(), s.categories(), s.search_index(), rating_first=True)


def search_results(s: Shapes) -> DataFrame:
    """Keyword results of every product name, with category names."""
    asked = keyword_queries(s)
    return H.hydrate(S.product_search(asked, s.catalog(), 20, s.search_index()), s.catalog().select("id", "name", "category_name", "rating"))


@query("h6_rerank", f"""
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC NULLS LAST, before, id) AS rank
FROM (SELECT query_id, id, rank AS before FROM ({search_sql('x_query', 20)})) JOIN (SELECT id, rating FROM x_prod) USING (id) QUALIFY rank <= 5""")
def h6(s: Shapes) -> DataFrame:
    return H.rerank(search_results(s), 5, "rating").select("query_id", "id", "rank")


@query("j9_hydrate_results", f"""
SELECT query_id, id, rank, p.name, p.category_name FROM ({search_sql('x_query', 20)}) JOIN x_pc p USING (id)""")
def j9(s: Shapes) -> DataFrame:
    return search_results(s).select("query_id", "id", "rank", "name", "category_name")


COMMON = f"""
SELECT query_id, category_name AS category FROM ({search_sql('x_query', 20)}) JOIN (SELECT id, category_name FROM x_pc) USING (id)
WHERE rank <= 10 GROUP BY query_id, category_name QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, category_name) = 1"""


@query("a7_most_common_category", COMMON)
def a7(s: Shapes) -> DataFrame:
    return H.most_common_category(search_results(s))


@query("s7_publish_ai_event", f"""
SELECT q.query_id, q.query, coalesce(c.category, '') AS category, coalesce(q.max_price, 0.0) AS max_price, coalesce(n, 0) AS results_count,
  coalesce(ids, '') AS returned_product_ids, '2024-02-01T00:00:00Z' AS timestamp
FROM x_query q LEFT JOIN ({COMMON}) c USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(id, '|' ORDER BY rank) AS ids FROM ({search_sql('x_query', 20)}) GROUP BY 1) USING (query_id)""")
def s7(s: Shapes) -> DataFrame:
    none = F.lit(None).cast("string")
    asked = keyword_queries(s).select(
        "*", F.col("query_id").alias("user_id"), none.alias("session_id"), F.lit("searchProducts").alias("tool_name"),
        F.lit("HYBRID").alias("search_type"), none.alias("category"))
    return flat(H.ai_events(asked, search_results(s), "2024-02-01 00:00:00").withColumnRenamed("user_id", "query_id").select(
        "query_id", "query", "category", "max_price", "results_count", "returned_product_ids", "timestamp"))


@query("p15_universal_filter", f"""
SELECT c.user_id, c.product_id AS id FROM (SELECT DISTINCT user_id, product_id FROM x_views) c JOIN x_pc p ON p.id = c.product_id
JOIN (SELECT DISTINCT user_id, arg_min(category, (event_time, event_id)) AS category, min(CASE WHEN page_type = 'CART' THEN 1 ELSE 2 END) AS f
      FROM x_views JOIN (SELECT user_id, page_type FROM x_users) USING (user_id) GROUP BY user_id) q ON q.user_id = c.user_id
WHERE p.category_name = q.category AND p.price <= 30000 AND p.rating >= 2.2""")
def p15(s: Shapes) -> DataFrame:
    """Viewed products that meet a request for the user's first viewed category."""
    from ..operators.collecting import first_value
    views = s.timed_views()
    wanted = views.groupBy("user_id").agg(first_value("category", ["event_time", "event_id"]).alias("category"))
    none = F.lit(None).cast("string")
    rows = (
        views.select("user_id", F.col("product_id").alias("id")).distinct()
        .join(s.catalog().select("id", "price", "rating", "category_name", F.col("brand").alias("product_brand")), "id")
        .join(wanted, "user_id")
        .select("*", none.alias("query"), none.alias("brand"), F.lit(None).cast("double").alias("min_price"),
                F.lit(30000.0).alias("max_price"), F.lit(2.2).alias("min_rating")))
    return H.universal_filter(rows, s.categories()).select("user_id", "id")


# ---- suggestions ----

@staged
def user_profiles(s: Shapes) -> DataFrame:
    """One merged profile per user."""
    from ..operators.profiles import fold_profiles
    return fold_profiles(profiles_staged(s), ["session_id"], "2024-02-01 00:00:00")


def query_vectors(s: Shapes) -> DataFrame:
    """(query, variant, embedding) for every text users searched: three vectors chosen by the text's length."""
    e = s.t("embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*")).scalar()
    texts = (
        s.t("part").select(F.col("p_name").alias("query"), F.col("p_partkey").alias("key"))
        .unionByName(s.t("conversations").filter("role = 'user'").select(
            F.col("text").alias("query"), (F.col("conv_id") * 8 + F.col("turn")).alias("key"))))
    texts = texts.filter(F.trim("query") != "").groupBy("query").agg(F.min("key").alias("key"), F.first(n).alias("_n"))
    return (texts.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .withColumn("vec_id", (F.col("key") + F.col("variant")) % F.col("_n"))
            .join(e, "vec_id").select("query", "variant", "embedding"))


cte("x_taken", """
SELECT user_id, product_id AS id FROM (SELECT DISTINCT user_id, product_id FROM x_views)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY product_id) <= CAST(user_id AS BIGINT) % 15""")


def already_taken(s: Shapes) -> DataFrame:
    """Some of the products a user has seen, none to fourteen of them."""
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("product_id"))
    return s.product_views().select("user_id", "product_id").distinct().withColumn("_n", rank).filter(
        F.col("_n") <= F.col("user_id").cast("bigint") % 15).select("user_id", F.col("product_id").alias("id"))


cte("x_cats", """
SELECT user_id, price_preference, unnest(cats) AS category, generate_subscripts(cats, 1) AS place, len(cats) AS n FROM (
  SELECT user_id, price_preference, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] AS cats FROM (
    SELECT user_id, price_preference, list_filter(list_concat(cart_categories, ai_search_categories, recent_categories), lambda x: trim(x) <> '') AS l
    FROM x_fold))""")
def _fold_sql() -> str:
    from .behaviour import merged
    pick = lambda c, n: f"CASE WHEN b.user_id IS NULL THEN a.{c} WHEN a.user_id IS NULL THEN b.{c} ELSE {merged(f'b.{c}', f'a.{c}', n)} END AS {c}"
    return f"""
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.price_preference, a.price_preference) AS price_preference,
  {pick('cart_categories', 10)}, {pick('ai_search_categories', 10)}, {pick('recent_categories', 10)}, {pick('recent_product_ids', 20)},
  {pick('ai_search_queries', 15)}, {pick('recent_search_queries', 10)},
  CASE WHEN b.user_id IS NULL THEN a.ai_max_budget WHEN a.user_id IS NULL THEN b.ai_max_budget ELSE greatest(a.ai_max_budget, b.ai_max_budget) END AS ai_max_budget
FROM (SELECT * FROM x_prof WHERE session_id LIKE '%-a') a FULL JOIN (SELECT * FROM x_prof WHERE session_id LIKE '%-b') b ON a.user_id = b.user_id"""


cte("x_fold", _fold_sql())


@query("r4_w5_category_affinity", """
SELECT user_id, id, category AS context, row_number() OVER (PARTITION BY user_id ORDER BY turn, place) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY place_in) AS turn FROM (
    SELECT c.user_id, c.category, c.place, p.id, 12 - coalesce(t.n, 0) AS room, row_number() OVER (PARTITION BY c.user_id, c.place
      ORDER BY p.rating DESC NULLS LAST, p.review_count DESC, p.id) AS place_in, greatest(2, (12 - coalesce(t.n, 0)) // c.n + 1) AS per
    FROM x_cats c LEFT JOIN (SELECT user_id, count(*) AS n FROM x_taken GROUP BY 1) t ON t.user_id = c.user_id
    JOIN x_pc p ON p.category_name = c.category AND p.status = 'ACTIVE'
      AND p.price >= CASE c.price_preference WHEN 'BUDGET' THEN 0 WHEN 'MID_RANGE' THEN 500 ELSE 2000 END
      AND p.price <= CASE c.price_preference WHEN 'BUDGET' THEN 500 WHEN 'MID_RANGE' THEN 2000 ELSE 1e12 END
    WHERE coalesce(t.n, 0) < 12 QUALIFY place_in <= per) ANTI JOIN x_taken USING (user_id, id)) QUALIFY rank <= room""")
def r4(s: Shapes) -> DataFrame:
    return G.category_affinity(user_profiles(s), s.catalog(), already_taken(s), 12).select("user_id", "id", "context", "rank")


@query("r5_similar_to_viewed", f"""
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT u.user_id, f.id, f.similarity, room FROM (
    SELECT user_id, recent_product_ids[1] AS item_id, least(50 - coalesce(n, 0), 15) AS room
    FROM x_fold LEFT JOIN (SELECT user_id, count(*) AS n FROM x_taken GROUP BY 1) USING (user_id)) u
  JOIN ({SIMILAR.replace('{n}', '45')}) f USING (item_id) WHERE fetched <= 3 * room) ANTI JOIN x_taken USING (user_id, id) QUALIFY rank <= room""")
def r5(s: Shapes) -> DataFrame:
    return G.similar_to_viewed(user_profiles(s), s.catalog(), s.leaf_index(), already_taken(s), 50, THRESHOLD).select(
        "user_id", "id", "rank")


QUOTA = 5  # of 12 suggestions, those that searches may fill
FILLED = "list_filter({}, lambda x: trim(x) <> '')"
cte("x_search", f"""
SELECT user_id, generate_subscripts(l, 1) - 1 AS step, unnest(l).expanded AS expanded, unnest(l).query AS query, max_price FROM (
  SELECT user_id, CASE WHEN ai_max_budget > 0 THEN ai_max_budget END AS max_price, list_concat(
    list_transform({FILLED.format('ai_search_queries')}[1:2], lambda q: {{'expanded': true, 'query': q}}),
    list_transform({FILLED.format('recent_search_queries')}[1:3], lambda q: {{'expanded': false, 'query': q}})) AS l
  FROM x_fold)""")
cte("x_qvec", """
SELECT query, variant, CAST(embedding AS DOUBLE[]) AS v FROM (
  SELECT query, min(key) AS key FROM (SELECT p_name AS query, p_partkey AS key FROM part
    UNION ALL SELECT text, conv_id * 8 + turn FROM conversations WHERE role = 'user') WHERE trim(query) <> '' GROUP BY query)
CROSS JOIN (VALUES (0), (1), (2)) t(variant) JOIN embeddings ON vec_id = (key + variant) % (SELECT count(*) FROM embeddings)""")
cte("x_asked", """
SELECT expanded, query, max_price, variant, v, CASE WHEN expanded THEN 3 ELSE 1 END AS variants,
  row_number() OVER (ORDER BY expanded, query, max_price, variant) AS query_id, NULL::DOUBLE AS min_price, NULL::DOUBLE AS min_rating
FROM (SELECT DISTINCT expanded, query, max_price FROM x_search) JOIN x_qvec USING (query) WHERE expanded OR variant = 0""")
cte("x_interest", f"""
SELECT user_id, unnest(base) AS requested FROM (SELECT user_id, list_concat({FILLED.format('ai_search_categories')},
  {FILLED.format('recent_categories')}) AS base FROM x_fold)""")
cte("x_ireq", "SELECT DISTINCT requested FROM x_interest")
cte("x_iexpand", EXPAND.replace("x_req", "x_ireq"))
cte("x_step", f"""
SELECT s.user_id, s.step, s.expanded, s.query, max(a.variants) AS n, list({{'s': f.similarity, 'id': f.id, 'r': f.rank, 'fits':
  s.user_id NOT IN (SELECT user_id FROM x_interest) OR (s.user_id, p.category_name) IN (
    SELECT user_id, category_name FROM x_interest JOIN x_iexpand USING (requested))}} ORDER BY f.similarity DESC, f.id) AS hits
FROM x_search s JOIN x_asked a ON a.expanded = s.expanded AND a.query = s.query AND a.max_price IS NOT DISTINCT FROM s.max_price
JOIN ({vector_sql('x_asked', '15', in_bounds('q', 'i'))}) f USING (query_id) JOIN x_pc p ON p.id = f.id GROUP BY ALL""")
cte("x_intent", f"""
SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS rank, unnest(context) AS context FROM (
  WITH RECURSIVE steps AS MATERIALIZED (SELECT * FROM x_step),
  walk(user_id, step, ids, context) AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM steps
    UNION ALL SELECT user_id, step + 1, list_concat(ids, list_transform(added, lambda h: h.id)),
      list_concat(context, list_transform(added, lambda h: short)) FROM (
      SELECT user_id, step, ids, context, short, CASE WHEN query IS NULL OR missing <= 0 THEN [] WHEN len(list_filter(fresh, lambda h: h.fits)) > 0
        THEN list_filter(fresh, lambda h: h.fits)[1:missing] ELSE fresh[1:missing] END AS added FROM (
        SELECT *, list_filter(list_filter(near, lambda h, i: list_position(list_transform(near, lambda y: y.id), h.id) = i)[1:wide],
          lambda h: NOT list_contains(ids, h.id)) AS fresh FROM (
          SELECT *, list_filter(hits, lambda h: h.r <= CASE WHEN n > 1 THEN greatest(3, CAST(ceil(wide / n) AS BIGINT) + 1) ELSE wide END) AS near,
            CASE WHEN length(query) > width THEN substr(query, 1, width - 3) || '...' ELSE query END AS short FROM (
            SELECT w.*, s.query, s.n, s.hits, {QUOTA} - len(w.ids) AS missing, greatest(10, ({QUOTA} - len(w.ids)) * 3) AS wide,
              CASE WHEN s.expanded THEN 40 ELSE 30 END AS width
            FROM walk w LEFT JOIN steps s ON s.user_id = w.user_id AND s.step = w.step WHERE w.step < 5)))))
  SELECT * FROM walk WHERE step = 5)""")


@query("r3_ai_intent", "SELECT user_id, id, rank, context FROM x_intent")
def r3(s: Shapes) -> DataFrame:
    return G.ai_intent(user_profiles(s), s.catalog(), s.categories(), s.leaf_index(), query_vectors(s), 12, THRESHOLD)


def all_users(s: Shapes) -> DataFrame:
    return s.t("customer").select(F.col("c_custkey").cast("string").alias("user_id"))


cte("x_alike", f"""
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, id) AS rank,
  CASE WHEN length(name) > 30 THEN substr(name, 1, 30) || '...' ELSE name END AS context FROM (
  SELECT u.user_id, f.id, f.similarity, room, p.name FROM (
    SELECT user_id, recent_product_ids[1] AS item_id, least(12 - coalesce(n, 0), 4) AS room
    FROM x_fold LEFT JOIN (SELECT user_id, count(*) AS n FROM x_intent GROUP BY 1) USING (user_id)) u
  JOIN ({SIMILAR.replace('{n}', '12')}) f USING (item_id) JOIN x_pc p ON p.id = u.item_id WHERE fetched <= 3 * room)
ANTI JOIN x_intent USING (user_id, id) QUALIFY rank <= room""")
cte("x_sofar", "SELECT user_id, id FROM x_intent UNION ALL SELECT user_id, id FROM x_alike")
cte("x_affine", """
SELECT user_id, id, category AS context, row_number() OVER (PARTITION BY user_id ORDER BY turn, place) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY place_in) AS turn FROM (
    SELECT c.user_id, c.category, c.place, p.id, 12 - coalesce(t.n, 0) AS room, row_number() OVER (PARTITION BY c.user_id, c.place
      ORDER BY p.rating DESC NULLS LAST, p.review_count DESC, p.id) AS place_in, greatest(2, (12 - coalesce(t.n, 0)) // c.n + 1) AS per
    FROM x_cats c LEFT JOIN (SELECT user_id, count(*) AS n FROM x_sofar GROUP BY 1) t ON t.user_id = c.user_id
    JOIN x_pc p ON p.category_name = c.category AND p.status = 'ACTIVE'
      AND p.price >= CASE c.price_preference WHEN 'BUDGET' THEN 0 WHEN 'MID_RANGE' THEN 500 ELSE 2000 END
      AND p.price <= CASE c.price_preference WHEN 'BUDGET' THEN 500 WHEN 'MID_RANGE' THEN 2000 ELSE 1e12 END
    WHERE coalesce(t.n, 0) < 12 QUALIFY place_in <= per) ANTI JOIN x_sofar USING (user_id, id)) QUALIFY rank <= room""")


@query("r6_suggest", """
WITH listed AS (
  SELECT user_id, id, strategy, reason, row_number() OVER (PARTITION BY user_id ORDER BY place, rank, id) AS position FROM (
    SELECT user_id, id, 0 AS place, rank, 'ai_intent' AS strategy, 'Based on your search for ' || context AS reason FROM x_intent
    UNION ALL SELECT user_id, id, 1, rank, 'similar_products', 'Similar to ' || context FROM x_alike
    UNION ALL SELECT user_id, id, 2, rank, 'category_affinity', 'Popular in ' || context FROM x_affine) QUALIFY position <= 12)
SELECT u.user_id, coalesce(position, 0) AS position, coalesce(id, '') AS id, coalesce(strategy, '') AS strategy, coalesce(reason, '') AS reason,
  CASE WHEN u.user_id IN (SELECT user_id FROM x_fold) THEN 1 ELSE 0 END AS personalised
FROM (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer) u LEFT JOIN listed l ON l.user_id = u.user_id""".replace(
    "WITH listed AS (", "SELECT * FROM (WITH listed AS (", 1) + ")")
def r6(s: Shapes) -> DataFrame:
    df = G.suggest(all_users(s), user_profiles(s), s.catalog(), s.categories(), s.leaf_index(), query_vectors(s), 12, THRESHOLD)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select("user_id", F.coalesce("position", F.lit(0)).alias("position"), text("id"), text("strategy"), text("reason"),
                     F.col("personalised").cast("int").alias("personalised"))
