"""Search terms: words, stop words, a light English stemmer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: the usual English stop words --------------------------------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now
""".split()
# -------------------------------------------------------------------------------------------


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def word_list(text: Column) -> Column:
    """The words of a text in lower case, in order, without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def exploded_terms(df: DataFrame, keep: list[str], text: str, distinct: bool = True) -> DataFrame:
    """(keep..., term): stemmed search terms of a text column, one row per distinct word, or per word.

    Words are exploded before they are stemmed, so the patterns run once per distinct word
    of a text in generated code. Two words of a text may share a stem.

    The light stemmer handles plurals, -ing, -ed and a final e, for words of four letters or more.
    """
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    parts = F.array_distinct(parts) if distinct else parts
    words = df.select(*keep, F.explode(parts).alias("_w")).filter(f"_w != '' AND _w NOT IN ({_STOPS})")
    # Patterns run only on words with the ending they change.
    plural = F.regexp_replace("_w", "(ss)es$", "$1")
    plural = F.regexp_replace(plural, "([a-z][a-z])ies$", "$1y")
    plural = F.regexp_replace(plural, "([^sui])s$", "$1")
    long = F.length("_w") >= 4
    words = words.withColumn("_p", F.when(long & F.endswith(F.col("_w"), F.lit("s")), plural).otherwise(F.col("_w")))
    ending = F.endswith(F.col("_p"), F.lit("ing")) | F.endswith(F.col("_p"), F.lit("ed"))
    words = words.withColumn("_c", F.when(long & ending, F.regexp_replace(
        "_p", "^(.*[aeiouy].+)(ing|ed)$", "$1")).otherwise(F.col("_p")))
    doubled = (F.col("_c") != F.col("_p")) & F.col("_c").rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
    words = words.withColumn(
        "_c", F.when(doubled, F.substring("_c", F.lit(1), F.length("_c") - 1)).otherwise(F.col("_c")))
    final = long & F.endswith(F.col("_c"), F.lit("e")) & (F.length("_c") >= 5)
    stemmed = F.when(final, F.regexp_replace("_c", "^(....+)e$", "$1")).otherwise(F.col("_c"))
    return words.select(*keep, stemmed.alias("term"))


def term_sets(df: DataFrame, key: str, text: str, out: str = "terms") -> DataFrame:
    """(key, terms): the set of search terms of each row's text; rows without terms are absent."""
    return exploded_terms(df, [key], text).groupBy(key).agg(F.collect_set("term").alias(out))
