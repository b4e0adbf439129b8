"""Secrets in texts, and who owns them across the corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

# The kinds in their listed order, each with a pattern whose first group is the match and whose second is
# the candidate secret, the least length of the secret, and a pattern that a text with such a span contains.
KINDS = {
    "assign": (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 6,
               r"(?:[Ww][Oo][Rr][Dd]|[Ss][Ww][Dd]|[Cc][Rr][Ee][Tt]|[Kk][Ee][Nn]|[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
               r"[A-Za-z0-9+/_.=-]{6}"),
    "access": (r"((AKIA[A-Z0-9]+))", 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"(([0-9a-f]{24,}))", 24, r"[0-9a-f]{24}"),
    "owned": (r"(([A-Za-z0-9+/_-]{20,}))", 20, r"[A-Za-z0-9+/_-]{20}"),
}
BASE = ["assign", "access", "hex"]


def _found(text: Column, kind: str) -> Column:
    """All matches of one kind, left to right, as structs of the gap before, the match's length and the secret.

    Every search begins where the last match ended (\\G), so texts are read once however long they are.
    """
    pattern, least, gate = KINDS[kind]
    part = lambda group: F.regexp_extract_all(text, F.lit(r"\G(?s)(.*?)" + pattern), F.lit(group))
    zipped = F.arrays_zip(part(1).alias("gap"), part(2).alias("match"), part(3).alias("secret"))
    found = F.transform(zipped, lambda m, i: F.struct(
        i.alias("i"), F.char_length(m["gap"]).alias("gap"), F.char_length(m["match"]).alias("size"),
        m["secret"].alias("secret")))
    return F.when(text.rlike(gate), found)


def secret_scan(docs: DataFrame, owner_col: str = "source", repository_col: str = "lang", id_col: str = "doc_id",
                text_col: str = "text", max_owners: int = 1, max_repositories: int = 2, example_owners: int = 3,
                example_repositories: int = 4) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example,
    most_owners, most_repositories.

    Base kinds are found left to right without overlaps, per kind, in the whole text: `assign` (a labelled value of
    6 characters or more), `access` (AKIA ids of 20 or more), `hex` (24 or more digits). Spans are written
    kind:start:end in code points, by start, then by kind; base_sha256 is over the base spans alone.

    Corpus-wide ownership: the hash of every candidate secret is aggregated by distinct owner and repository (an
    owner's repository). A secret under at most `max_owners` owners and in at most `max_repositories` repositories looks
    live (n_live counts a document's base spans of that sort); one under `example_owners` owners or more, or in
    `example_repositories` repositories or more, of one owner even, is a copied example (n_example). most_owners and
    most_repositories are the highest numbers of the document's base spans, 0 without one. The method adds spans of
    kind `owned`: tokens of 20 or more characters with lower-case, upper-case and digits, outside every base span, that
    look live; widely copied ones are examples and add nothing.

    Only built-in functions run. Texts are read in place; what is shuffled are candidates, pre-aggregated by
    (hash, owner, repository), and joins read written tables, so a secret that very many rows copy is split by
    adaptive execution.

    Null texts count as empty: no spans, the SHA-256 of nothing and "". Null owners and repositories count as one
    owner each. Rows that repeat an id, or have none, are rows of their own. An empty table gives no rows. Other
    columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"))
    found = materialise(rows.select("doc_id", "owner", "repository", *[
        _found(F.col("text"), k).alias(k) for k in KINDS]).withColumn("row", F.monotonically_increasing_id()), "found")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = None
    for rank, kind in enumerate(KINDS):
        one = found.where(F.size(kind) > 0).select(
            "row", "owner", "repository", F.lit(rank).alias("kind"), F.inline(kind))
        spans = one if spans is None else spans.unionByName(one)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS.values()]), F.col("kind") + 1)
    secret, owned = F.col("secret"), F.col("kind") == len(BASE)
    spans = spans.withColumn("stop", end).withColumn("start", F.col("stop") - F.col("size")).where(
        (F.char_length(secret) >= least) & (
            ~owned | (secret.rlike("[a-z]") & secret.rlike("[A-Z]") & secret.rlike("[0-9]"))))
    order = Window.partitionBy("row").orderBy("start", "kind")
    last_end = F.max(F.when(~owned, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(~owned, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("last_end", last_end).withColumn("next_start", next_start).where(
        ~owned | (F.coalesce(F.col("last_end") <= F.col("start"), F.lit(True))
                  & F.coalesce(F.col("next_start") >= F.col("stop"), F.lit(True))))
    spans = materialise(spans.select("row", "owner", "repository", "kind", "start", "stop",
                                     F.sha2("secret", 256).alias("hash")), "candidates")
    owners = spans.groupBy("hash", "owner", "repository").count().groupBy("hash", "owner").agg(
        F.count("*").alias("repositories")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    judged = spans.join(materialise(owners, "owners"), "hash").where((F.col("kind") < len(BASE)) | live)
    of = lambda rank: F.count(F.when(F.col("kind") == rank, True))
    base = F.col("kind") < len(BASE)
    shown = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "stop")
    item = F.struct("start", "kind", shown.alias("shown"))
    summary = judged.groupBy("row").agg(
        *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.count(F.when(base & live, True)).alias("n_live"), F.count(F.when(base & example, True)).alias("n_example"),
        F.max(F.when(base, F.col("owners"))).alias("most_owners"),
        F.max(F.when(base, F.col("repositories"))).alias("most_repositories"),
        F.array_sort(F.collect_list(item)).alias("all"), F.array_sort(F.collect_list(F.when(base, item))).alias("base"))
    text_of = lambda c: F.concat_ws(",", F.transform(F.coalesce(F.col(c), F.array()), lambda s: s["shown"]))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
              for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_example", "most_owners",
                        "most_repositories")]
    return found.select("row", "doc_id").join(summary, "row", "left").select(
        "doc_id", *counts[:3], F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all").alias("spans"), *counts[3:])


def oracle() -> str:
    """The same for DuckDB, over a table `documents` with owner `source` and repository `lang`."""
    parts = []
    for rank, (kind, (pattern, least, _)) in enumerate(KINDS.items()):
        extra = "" if kind != "owned" else ("AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') "
                                            "AND regexp_matches(secret, '[0-9]')")
        quoted = ("(?s)(.*?)" + pattern).replace("'", "''")
        parts.append(f"""
      SELECT * FROM (
        SELECT r, owner, repository, {rank} AS kind, '{kind}' AS name, secret,
               sum(length(gap) + length(found)) OVER (PARTITION BY r ORDER BY i) AS stop,
               sum(length(gap) + length(found)) OVER (PARTITION BY r ORDER BY i) - length(found) AS start
        FROM (SELECT r, owner, repository, unnest(regexp_extract_all(text, '{quoted}', 1)) AS gap,
                     unnest(regexp_extract_all(text, '{quoted}', 2)) AS found,
                     unnest(regexp_extract_all(text, '{quoted}', 3)) AS secret,
                     generate_subscripts(regexp_extract_all(text, '{quoted}', 1), 1) AS i FROM d))
      WHERE length(secret) >= {least} {extra}""")
    union = "\n      UNION ALL".join(parts)
    return rf"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
             coalesce(lang, '') AS repository FROM documents),
    raw AS MATERIALIZED ({union}),
    spans AS (SELECT * FROM raw s WHERE kind < 3 OR NOT EXISTS (
      SELECT 1 FROM raw b WHERE b.r = s.r AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop)),
    owners AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories
               FROM spans GROUP BY secret),
    judged AS (SELECT * FROM spans JOIN owners USING (secret) WHERE kind < 3 OR (owners <= 1 AND repositories <= 2)),
    summary AS (
      SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
             count(*) FILTER (kind < 3 AND owners <= 1 AND repositories <= 2) AS n_live,
             count(*) FILTER (kind < 3 AND (owners >= 3 OR repositories >= 4)) AS n_example,
             max(owners) FILTER (kind < 3) AS most_owners, max(repositories) FILTER (kind < 3) AS most_repositories,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base
      FROM judged GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
           coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
           coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
    FROM d LEFT JOIN summary USING (r)"""
