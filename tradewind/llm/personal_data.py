"""Personal data in texts: spans of fixed formats, and more that boosted trees select. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .boosting import BoostedTrees
from .common import fold_of

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The kinds in their listed order, each with the text before a match (only places where one can begin),
# the match, and a pattern that a text with a passing match contains. Possessive where nothing could be given back.
BASE = {
    "email": (rf"(|(?s:.*?)(?<!{LOCAL}))", rf"({LOCAL}++@{LABEL}++(?:\.{LABEL}++)++)", rf"{LOCAL}@{LABEL}++\.{LABEL}"),
    "ip": (r"(|(?s:.*?)(?<![0-9]))", r"([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"((?s:.*?))", r"([0-9](?:[\x20-]?[0-9])++)", r"(?:[0-9][\x20-]?){11}[0-9]"),
    "phone": (r"((?s:.*?))", r"(\+[0-9][\x20().0-9-]+[0-9])", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Generators of candidates, wider than the base kinds and overlapping them.
GENERATORS = {
    "number": (r"(|(?s:.*?)(?<![A-Za-z0-9@_]))", r"([0-9](?:[\x20.()/-]{0,2}[0-9]){6,30}+)(?![A-Za-z0-9@_])",
               r"(?:[0-9][\x20.()/-]{0,2}){6}[0-9]"),
    "address": (r"(|(?s:.*?)(?<![^\s@,;<>()\"']))", r"([^\s@,;<>()\"']++(?:@|\((?:at|AT)\))[^\s@,;<>()\"']++)", r"@|\((?:at|AT)\)"),
}
KINDS = [*BASE, *GENERATORS]
#: Words before a candidate that say what follows, in the four languages; the first that fits counts.
CUES = [r"e-?mail|@|courriel|correo", r"tel|phone|call|fax|mobil|handy|anruf|appel|llam", r"card|visa|iban|account|konto|karte|carte"
        r"|compte|tarjeta|cuenta", r"\bip\b|host|server|serveur|servidor"]
BEFORE = 24
#: Values of each feature; their product bounds the classes that training brings to the driver.
VALUES = {"generator": 2, "digits": 7, "separators": 5, "cue": 5, "previous": 4, "next": 4, "groups": 5, "opening": 3}


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind, left to right: the length of the gap before, its last characters, the match, the next one."""
    gap, match, gate = {**BASE, **GENERATORS}[kind]
    part = lambda group: F.regexp_extract_all(text, F.lit(r"\G" + gap + match + r"(?=((?s:.?)))"), F.lit(group))
    fields = [part(1).alias("gap"), part(2).alias("match")] + ([part(3).alias("next")] if kind in GENERATORS else [])
    found = F.transform(F.arrays_zip(*fields), lambda m, i: F.struct(
        i.alias("i"), F.char_length(m["gap"]).alias("gap"), m["match"].alias("match"),
        *([F.right(m["gap"], F.lit(BEFORE)).alias("before"), m["next"].alias("next")] if kind in GENERATORS else [
            F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("next")])))
    return F.when(text.rlike(gate), found)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    """Whether a match of a base kind is personal data by its own rule; matches of generators always stay."""
    n = F.length(_digits(match))
    return {"email": F.lit(True), "ip": match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
            "card": n.between(12, 19) & F.call_function("luhn_check", _digits(match)), "phone": n.between(9, 15)}.get(kind, F.lit(True))


def _bin(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds the value reaches."""
    return sum([(value >= b).cast("int") for b in bounds], F.lit(0))


def features(generator: Column, match: Column, before: Column, following: Column) -> dict[str, Column]:
    """Format and context of a candidate as small integers. Neither the checksum nor the leading + of base kinds is among them."""
    digits, previous = _digits(match), F.right(before, F.lit(1))
    seen = lambda pattern: match.rlike(pattern)
    spaces, hyphens, dots, others = (seen(p).cast("int") for p in (r"\x20", "-", r"\.", "[()/]"))
    cue = F.lit(0)
    for i in reversed(range(len(CUES))):
        cue = F.when(before.rlike("(?i)(?:" + CUES[i] + ")"), i + 1).otherwise(cue)
    return {
        "generator": generator, "digits": _bin(F.length(digits), [7, 9, 12, 16, 17, 20]),
        "separators": F.when(spaces + hyphens + dots + others > 1, 4).when(others == 1, 4).when(spaces == 1, 1).when(
            hyphens == 1, 2).when(dots == 1, 3).otherwise(0),
        "cue": cue,
        "previous": F.when((previous == "") | previous.rlike(r"^[\s+]$"), 0).when(previous.rlike("^[A-Za-z0-9]$"), 1).when(
            previous.rlike(r"^[$€£#=\"'/]$"), 2).otherwise(3),
        "next": F.when((following == "") | following.rlike(r"^\s$"), 0).when(following.rlike("^[.,;:!?]$"), 1).when(
            following.rlike("^[\"')\\]]$"), 2).otherwise(3),
        "groups": _bin(F.size(F.split(match, "[^0-9]+")), [2, 3, 4, 5]),
        "opening": F.when(generator == 1, F.when(seen(r"\.[A-Za-z]{2,}$"), 1).otherwise(0)).when(
            digits.rlike("^[3-6]"), 1).when(digits.startswith("0"), 2).otherwise(0)}


def _candidates(docs: DataFrame, id_col: str, text_col: str, **kept: Column) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all documents and the columns `kept`, and all passing base spans and candidates with their places and features.

    `base` says for a candidate whether a base span overlaps it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[c.alias(n) for n, c in kept.items()])
    found = materialise(rows.select("doc_id", *kept, *[_found(F.col("text"), k).alias(k) for k in KINDS]).withColumn(
        "row", F.monotonically_increasing_id()), "found")
    spans = None
    for rank, kind in enumerate(KINDS):
        one = found.where(F.size(kind) > 0).select("row", "doc_id", F.lit(rank).alias("kind"), F.inline(kind))
        spans = one if spans is None else spans.unionByName(one)
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size, is_base = F.char_length("match"), F.col("kind") < len(BASE)
    spans = spans.withColumn("stop", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("stop") - size)
    passing = F.lit(True)
    for rank, kind in enumerate(BASE):
        passing = F.when(F.col("kind") == rank, _passes(kind, F.col("match"))).otherwise(passing)
    order = Window.partitionBy("row").orderBy("start", "kind")
    ended = F.max(F.when(is_base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    spans = spans.where(passing).withColumn("ended", ended).withColumn("begins", begins)
    own = features(F.col("kind") - len(BASE), F.col("match"), F.col("before"), F.col("next"))
    overlaps = F.coalesce(F.col("ended") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("begins") < F.col("stop"), F.lit(False))
    spans = spans.select("row", "doc_id", "kind", "start", "stop", overlaps.alias("base"),
                         *[F.when(~is_base, c).cast("int").alias(n) for n, c in own.items()])
    return found.select("row", "doc_id", *kept), materialise(spans, "spans")


def fit(spans: DataFrame, precision: float = 0.95, folds: int = 4, **options) -> tuple[BoostedTrees, float | None]:
    """Trees that tell candidates on a base span from others, and the margin from which held-out ones reach the precision.

    Candidates are counted by class, the values of all features; the number of classes is bounded by VALUES, whatever
    the corpus. One fold of documents (crc32 of the id) is kept from the trees and sets the threshold.
    """
    held = fold_of(F.col("doc_id"), folds) == 0
    classes = spans.where(F.col("kind") >= len(BASE)).groupBy(*VALUES, held.alias("held")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("base"), True)).alias("positive")).collect()
    split = {h: [(tuple(r[f] for f in VALUES), r["n"], r["positive"]) for r in classes if r["held"] == h] for h in (True, False)}
    trees = BoostedTrees.fit(split[False], **options)
    return trees, trees.threshold(split[True], precision)


def personal_spans(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text",
                   **kept: Column) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all documents and the columns `kept`, and their spans (row, kind, start, stop) in code points, end exclusive.

    Base spans are the matches of BASE that pass their kind's rule. The candidates of GENERATORS that no base span
    overlaps are added where the trees' margin reaches the threshold.
    """
    rows, spans = _candidates(docs, id_col, text_col, **kept)
    trees, least = fit(spans, precision)
    added = F.lit(False) if least is None else ~F.col("base") & (
        F.round(trees.column([F.col(f) for f in VALUES]), 9) >= round(least, 9))
    names = F.array(*map(F.lit, KINDS))
    return rows, spans.where((F.col("kind") < len(BASE)) | added).select(
        "row", F.element_at(names, F.col("kind") + 1).alias("kind"), F.col("kind").alias("rank"), "start", "stop")


def personal_data(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Base spans are found left to right without overlaps, per kind, in the whole text: `email`, `ip` (parts up to 255),
    `card` (12 to 19 digits with a right check digit) and `phone` (a plus and 9 to 15 digits). Spans are written
    kind:start:end in code points, by start, then by kind; base_sha256 is over the base spans alone.

    The method adds spans. High-recall generators propose overlapping candidates: `number` (7 to 31 digits with
    separators) and `address` (anything around an @ or (at)). A candidate on a base span is a positive example,
    another one a negative, in all documents; boosted trees learn from format and context, without the checks that make the
    base kinds. Held-out documents set the margin from which `precision` of the candidates are positive, and candidates
    beyond it that no base span touches are added.

    Only built-in functions run, the trees as column expressions; what is shuffled are candidates. Training brings counts by
    feature class to the driver, at most the product of VALUES times two.

    Null texts count as empty: no spans, the SHA-256 of nothing and "". Rows that repeat an id, or have none, are rows
    of their own. An empty table gives no rows. Other columns are not looked at.
    """
    rows, spans = personal_spans(docs, precision, id_col, text_col)
    is_base = F.col("rank") < len(BASE)
    item = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "stop").alias("shown"))
    summary = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("rank") == i, True)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.count(F.when(~is_base, True)).alias("n_added"),
        F.array_sort(F.collect_list(item)).alias("all"), F.array_sort(F.collect_list(F.when(is_base, item))).alias("base"))
    text_of = lambda c: F.concat_ws(",", F.transform(F.coalesce(F.col(c), F.array()), lambda s: s["shown"]))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in [f"n_{k}" for k in BASE] + ["n_added"]]
    return rows.join(summary, "row", "left").select(
        "doc_id", *counts[:4], F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all").alias("spans"), counts[4])


def redacted(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, each selected span of the text replaced by its kind: `[EMAIL]`.

    Of overlapping spans the first is replaced, the rest of a later one without a mark. Null texts stay null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, spans = personal_spans(docs, precision, id_col, text_col, document=whole)
    marks = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("spans"))
    text = F.col("document").getField(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done, span):
        mark = F.when(span["start"] >= done["at"], F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise("")
        gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], span["stop"]).cast("long").alias("at"), F.concat(done["out"], gap, mark).alias("out"))

    new = F.aggregate("spans", begin, step, lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))
    joined = rows.join(marks, "row", "left").withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(new))
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col("document").getField(c).alias(c)
                           for c in docs.columns])
