"""Array and timestamp expressions shared by the activity aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def default_blank(values: Column) -> Column:
    """Null or empty array becomes `['']`, the form published to profile readers."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(values)


def sorted_field(structs: Column, field: str) -> Column:
    """One field of an array of structs (none of them null) in the order of the structs, as compiled code.

    `array_sort` and `transform` call their functions through the interpreter, for every comparison and element.
    """
    return F.sort_array(structs).getField(field)


def not_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def strip_blanks(values: Column) -> Column:
    return F.coalesce(F.filter(values, not_blank), F.array().cast("array<string>"))


def merge_lists(incoming: Column, existing: Column, cap: int) -> Column:
    """Incoming values first, then existing ones; blanks dropped, repeats dropped, cut to `cap`."""
    return F.slice(F.array_distinct(F.concat(strip_blanks(incoming), strip_blanks(existing))), 1, cap)


def latest_time_text(*times: Column) -> Column:
    """Latest of several nullable times as `yyyy-MM-dd HH:mm:ss`; all null gives the epoch."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return F.date_format(F.greatest(*[F.coalesce(t, epoch) for t in times]), "yyyy-MM-dd HH:mm:ss")


def safe_long(value: Column) -> Column:
    """Numeric text or number to BIGINT; anything else is 0."""
    return F.coalesce(value.cast("string").try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_double(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def ancestor_paths(path: Column, delimiter: str = " >> ") -> Column:
    """All prefixes of a category path, root first, the path itself last."""
    # A regex-quoted split keeps the delimiter literal.
    parts = F.split(path, r"\Q" + delimiter + r"\E")
    return F.when(
        path.isNotNull(),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), delimiter)),
    )


def category_path(primary: Column, subs: Column, delimiter: str = " >> ") -> Column:
    """Primary and sub category names trimmed, blanks dropped, each cut to 200, joined; null if none."""
    names = F.concat(F.array(primary), F.coalesce(subs, F.array().cast("array<string>")))
    kept = F.transform(F.filter(names, not_blank), lambda n: F.substring(F.trim(n), 1, 200))
    return F.when(F.size(kept) > 0, F.array_join(kept, delimiter))
