"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import NO_ID, fold_of, id_and_text

FOLDS, HELD_OUT = 4, 2
CHUNK = 1 << 20  # bytes looked at at once
STATISTICS = (
    "log words", "mean word length", "spread of word lengths", "log longest word", "upper case among ASCII letters",
    "digits", "symbols", "bars and slashes", "exclamation and question marks", "full stops and commas",
    "letters beyond ASCII", "white space", "line ends per word", "words equal to the one before", "distinct words",
    "words that end in two marks or more", "words without letters")
# The class of each byte. Bytes that continue a character have a class of their own.
LOWER, UPPER, DIGIT, SYMBOL, BAR, SHOUT, STOP, BEYOND, INNER, BLANK, LINE, OTHER = range(12)
MEMBERS = {LOWER: range(97, 123), UPPER: range(65, 91), DIGIT: range(48, 58), SYMBOL: b"#$%&*+=@^~<>`",
           BAR: b"|\\/_[]{}", SHOUT: b"!?", STOP: b".,;:", BEYOND: range(192, 256), INNER: range(128, 192),
           BLANK: b" \t\v\f\r", LINE: b"\n"}


def byte_classes():
    import numpy as np

    table = np.full(256, OTHER, np.uint8)
    for kind, members in MEMBERS.items():
        table[list(members)] = kind
    return table


#: What is summed over a document: the bytes of each class, then these.
SUMS = ("words", "lengths", "squares", "longest", "repeated", "marked", "bare", "distinct")


def count(data, sizes, classes):
    """Sums for each document of `data` (bytes, one document after the other), and the hash of every word."""
    import numpy as np

    n, docs = len(data), len(sizes)
    kind = classes[data]
    doc = np.repeat(np.arange(docs, dtype=np.int32), sizes)
    counts = np.bincount(doc * 12 + kind, minlength=docs * 12).reshape(docs, 12)
    inside = (kind < BLANK) | (kind == OTHER)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:]))
    of = doc[first]
    per_doc = lambda x: np.bincount(of, x, docs)
    characters = np.concatenate([[0], np.cumsum(kind != INNER, dtype=np.int32)])
    length = (characters[last + 1] - characters[first]).astype(float)
    longest = np.zeros(docs)
    np.maximum.at(longest, of, length)
    letters = np.concatenate([[0], np.cumsum((kind <= UPPER) | (kind == BEYOND), dtype=np.int32)])
    bare = letters[last + 1] == letters[first]
    mark = np.isin(kind, (SYMBOL, BAR, SHOUT, STOP, OTHER))
    marked = mark[last] & mark[np.maximum(last - 1, 0)] & (last > first)
    hashes = np.zeros(0, np.uint64)
    if len(first):  # a word's hash is the sum of its bytes times powers of an odd number, by prefix sums
        powers = np.cumprod(np.full(int((last - first).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(n, dtype=np.int32) - np.repeat(
            np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [n]]))).astype(np.int32)
        value = powers[np.minimum(place, len(powers) - 1)] * (data.astype(np.uint64) + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        hashes = sums[last + 1] - sums[first]
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=docs)
    return np.column_stack([counts, np.bincount(of, minlength=docs), per_doc(length), per_doc(length * length), longest,
                            per_doc(same), per_doc(marked), per_doc(bare), distinct]).astype(float), hashes


def count_long(data, classes):
    """Sums of one long document, part by part; parts end behind white space, or at CHUNK bytes of a longer word."""
    import numpy as np

    total, seen, end, at = None, np.zeros(0, np.uint64), None, 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        if stop < len(data):
            blanks = np.flatnonzero(np.isin(classes[data[at:stop]], (BLANK, LINE)))
            stop = at + int(blanks[-1]) + 1 if len(blanks) else stop
        sums, hashes = count(data[at:stop], np.array([stop - at]), classes)
        if total is None:
            total = sums
        else:
            longest = max(total[0, 12 + SUMS.index("longest")], sums[0, 12 + SUMS.index("longest")])
            total = total + sums
            total[0, 12 + SUMS.index("longest")] = longest
            total[0, 12 + SUMS.index("repeated")] += len(hashes) > 0 and hashes[0] == end
        end = hashes[-1] if len(hashes) else end
        seen = np.union1d(seen, hashes)
        at = stop
    total[0, 12 + SUMS.index("distinct")] = len(seen)
    return total


def statistics(sums):
    """The transformed statistics, one row for each row of sums."""
    import numpy as np

    of = dict(zip(SUMS, sums[:, 12:].T))
    least, chars = np.maximum(of["words"], 1), np.maximum(sums[:, :12].sum(axis=1) - sums[:, INNER], 1)
    mean = of["lengths"] / least
    share = lambda k: np.sqrt(sums[:, k] / chars)
    per_word = lambda x: np.sqrt(x / least)
    return np.column_stack([
        np.log1p(of["words"]), mean, np.sqrt(np.maximum(of["squares"] / least - mean * mean, 0)), np.log1p(of["longest"]),
        np.sqrt(sums[:, UPPER] / np.maximum(sums[:, LOWER] + sums[:, UPPER], 1)), share(DIGIT), share(SYMBOL), share(BAR),
        share(SHOUT), share(STOP), share(BEYOND), (sums[:, BLANK] + sums[:, LINE]) / chars, per_word(sums[:, LINE]),
        per_word(of["repeated"]), np.log1p(of["distinct"]) / np.log1p(least), per_word(of["marked"]), per_word(of["bare"])])


def text_statistics(texts, classes):
    """Blocks of rows of transformed statistics for an Arrow array of binary texts, a bounded number of bytes each."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        data = content[offsets[row]:offsets[end]]
        yield statistics(count_long(data, classes) if len(data) > CHUNK else count(
            data, np.diff(offsets[row:end + 1]), classes)[0])
        row = end


def _statistics_rows(batches):
    import numpy as np
    import pyarrow as pa

    classes = byte_classes()
    for batch in batches:
        row = 0
        for values in text_statistics(batch.column(2), classes):
            n = len(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()),
                                             pa.array(values.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n), batch.column(1).slice(row, n), lists], names=["id", "hash", "x"])
            row += n


def _moments(batches):
    """Sums of x and of its products with itself by label: a few hundred rows for each task."""
    import numpy as np
    import pyarrow as pa

    total = {}
    for batch in batches:
        labels = batch.column(0).to_numpy()
        x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
        for label in np.unique(labels):
            own = np.column_stack([np.ones((labels == label).sum()), x[labels == label]])
            total[int(label)] = total.get(int(label), 0) + own.T @ own
    for label, m in total.items():
        i, j = (k.ravel() for k in np.indices(m.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, label)), pa.array(i), pa.array(j), pa.array(m.ravel())],
                                         names=["label", "i", "j", "value"])


class Discriminant:
    """Means and Cholesky factors of two classes; the score is a logistic function of the log-density difference."""

    def __init__(self, moments: dict, shrinkage: float, ridge: float):
        import numpy as np

        total = sum(moments.values())
        n = total[0, 0]
        self.mean = total[0, 1:] / n
        self.scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - self.mean ** 2, 1e-12))
        self.slope, self.base, self.factors = 1.0, 0.0, []
        pooled, parts = 0, []
        for label in (0, 1):
            m = moments[label]
            centre = m[0, 1:] / m[0, 0]
            cov = (m[1:, 1:] / m[0, 0] - np.outer(centre, centre)) / np.outer(self.scale, self.scale)
            pooled = pooled + cov * m[0, 0] / n
            parts.append(((centre - self.mean) / self.scale, cov, m[0, 0] / n))
        for centre, cov, prior in parts:
            cov = (1 - shrinkage) * cov + shrinkage * pooled + ridge * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.factors.append((centre, np.linalg.inv(lower).T, np.log(prior) - np.log(np.diag(lower)).sum()))

    def difference(self, x):
        """log p(x, 1) - log p(x, 0), from Mahalanobis distances."""
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -8, 8)
        density = [c - 0.5 * (((z - centre) @ inverse) ** 2).sum(axis=1) for centre, inverse, c in self.factors]
        return density[1] - density[0]

    def calibrate(self, difference, label) -> None:
        """Slope and base of the logistic function by a few Newton steps."""
        import numpy as np

        d = np.sign(difference) * np.log1p(np.abs(difference))
        x, w = np.column_stack([d, np.ones(len(d))]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - label) + 0.5 * (w - [1.0, 0.0])
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), gradient)
        self.slope, self.base = max(float(w[0]), 1e-3), float(w[1])

    def score(self, x):
        import numpy as np

        d = self.difference(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sign(d) * np.log1p(np.abs(d)) + self.base, -40, 40)))


def fit(labelled: DataFrame, shrinkage: float, ridge: float, sample: int) -> Discriminant | None:
    """A discriminant of rows (label, x); None unless both labels occur at least twice.

    The moments are summed over all rows; the logistic function is fitted on `sample` rows at most.
    """
    import numpy as np

    width = len(STATISTICS) + 1
    rows = labelled.select("label", "x").mapInArrow(_moments, "label long, i long, j long, value double").groupBy(
        "label", "i", "j").agg(F.sum("value").alias("value")).toPandas()
    moments = {}
    for label, own in rows.groupby("label"):
        moments[label] = np.zeros((width, width))
        moments[label][own["i"].to_numpy(), own["j"].to_numpy()] = own["value"].to_numpy()
    if any(moments.get(k, np.zeros((1, 1)))[0, 0] < 2 for k in (0, 1)):
        return None
    model = Discriminant({k: moments[k] for k in (0, 1)}, shrinkage, ridge)

    def differences(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                d = model.difference(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d)], names=["label", "d"])

    few = labelled.select("label", "x").orderBy(F.xxhash64("x")).limit(sample).mapInArrow(
        differences, "label long, d double").toPandas()
    model.calibrate(few["d"].to_numpy(float), few["label"].to_numpy(float))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str, shrinkage: float, ridge: float, sample: int, id_col: str,
          text_col: str) -> tuple[Discriminant | None, DataFrame]:
    """The discriminant of the labelled documents that are not held out, and the statistics of all documents."""
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"),
        F.col("text").cast("binary").alias("bytes"))
    stats = materialise(rows.mapInArrow(_statistics_rows, "id long, hash long, x array<double>"), "statistics")
    stats = stats.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")).where(
        F.col("label").isin(0, 1) & (fold_of(F.col("id"), FOLDS) != HELD_OUT)).dropDuplicates(["id"])
    return fit(materialise(stats.join(known, "id").select("label", "x"), "labelled"), shrinkage, ridge, sample), stats


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", shrinkage: float = 0.1,
                   ridge: float = 0.02, threshold: float = 0.7, sample: int = 20_000, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold), hash.

    Every whole text gives `STATISTICS`, transformed by logs and square roots, in one pass without a shuffle. For each
    label, mean and covariance are summed by Spark over all labelled documents that are not held out (crc32 of
    the id as text modulo 4 is 2); each covariance is shrunk towards the pooled one by `shrinkage` and gets `ridge`
    on its diagonal. The score is a logistic function, fitted on `sample` of those rows at most, of the difference of
    the two log densities, computed by Mahalanobis distances from Cholesky factors that are inverted once. Ids,
    labels and other columns are never inputs of a score.

    Long texts are read in parts of 1 MiB that end behind white space; a longer word counts as several.

    Null texts count as empty, and an empty text is scored from its (zero) statistics like any other. Null ids
    belong to fold 0 or 3 as the crc32 of the empty text says and match no label; rows that repeat an id are scored
    each by its own text, and each learns from the id's label. Labels other than 0 and 1, or null, are not learned.
    Without two documents of either label every score is 0.5. An empty table gives no rows.
    """
    model, stats = train(docs, labels, label_col, shrinkage, ridge, sample, id_col, text_col)
    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(3).to_numpy(zero_copy_only=False))
            scores = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores)],
                                             names=["doc_id", "hash", "held_out", "score"])

    return stats.select("doc_id", "hash", held_out, "x").mapInArrow(
        run, "doc_id long, hash long, held_out boolean, score double").select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hash")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, label_col: str = "quality",
                 shrinkage: float = 0.1, ridge: float = 0.02, sample: int = 20_000, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score `least` or more.

    The discriminant is that of `quality_scores`; every task scores and filters the rows it reads, so no text is
    shuffled. Texts are read twice, once to learn.
    """
    model, _ = train(docs, labels, label_col, shrinkage, ridge, sample, id_col, text_col)
    if model is None:
        return docs

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        classes = byte_classes()
        for batch in batches:
            if batch.num_rows:
                texts = pc.fill_null(batch.column(text_col).cast(pa.string()), "")
                scores = np.concatenate([model.score(x) for x in text_statistics(texts, classes)])
                yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
