"""Phrases whose parts go together, by counts kept in acyclic automata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .decontamination import _filter_words
from .transducer import CountTransducer

DEPTH = CountTransducer.DEPTH
SHARD_WORDS = 1_500_000  # words of one language whose phrases are counted at once
RANGE_BYTES = 16 << 20  # bytes of text for each prefix range
PENDING = 1_000_000  # phrases of shards that wait for a union
LANE_ROWS = 100_000  # part look-ups of a range that one task answers at once
# What ends a piece of a text, and what else separates words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"


def _spread(values):
    """64-bit numbers mixed well."""
    import numpy as np

    x = values.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _longer(hashes, more):
    """Hashes of prefixes that are one word longer."""
    import numpy as np

    return _spread(hashes * np.uint64(0x9E3779B97F4A7C15) + more)


def _range_of(hashes, ranges: int):
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def part_range(phrase: bytes, ranges: int) -> int:
    """The prefix range of a phrase: that of its first three words."""
    hashes = _word_hashes(phrase.split(b" ")[:DEPTH - 1])
    own = hashes[:1]
    for i in range(1, len(hashes)):
        own = _longer(own, hashes[i:i + 1])
    return int(_range_of(own, ranges)[0])


def _bit_of(pair_hashes, lang: str | None, bits: int):
    """The bit of the filter that stands for a pair of words of a language."""
    import numpy as np
    import xxhash

    mixed = _longer(pair_hashes, np.uint64(xxhash.xxh64_intdigest((lang or "").encode())))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _count(words, texts_ids, ranges: int, least_words: int, most_words: int, frequent=None):
    """(range, transducer) of all phrases of that many words in the sequence of word numbers; -1 ends a piece.

    `frequent` says of the hashes of word pairs which may be frequent; longer phrases with another pair are left out.
    """
    import numpy as np

    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words) + 1, np.int64)
    rank[order] = np.arange(len(words))
    rank[-1] = -1
    ids, words = np.append(rank[texts_ids], [-1] * DEPTH), [words[i] for i in order]
    base, hashes = len(words), _word_hashes(words)
    counts = np.bincount(ids[ids >= 0], minlength=base)
    levels = [(np.arange(base, dtype=np.int32)[:, None], counts, hashes)]
    pair = (ids[:-1] >= 0) & (ids[1:] >= 0)  # whether a pair to be looked at begins at a place
    if frequent is not None:
        at = np.flatnonzero(pair)
        pair[at] = frequent(_longer(hashes[ids[at]], hashes[ids[at + 1]]))
    at, above = ids, ids >= 0  # the number of the phrase that begins at each place
    for d in range(1, most_words):
        place = np.flatnonzero(above[:len(ids) - d] & pair[d - 1:])
        keys, own, counts = np.unique(at[place] * base + ids[place + d], return_inverse=True, return_counts=True)
        at, above = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at[place], above[place] = own, True
        grams, _, before = levels[-1]
        parent, word = keys // base, keys % base
        prefix = before[parent] if d == DEPTH - 1 else _longer(before[parent], hashes[word])
        levels.append((np.concatenate([grams[parent], word[:, None].astype(np.int32)], 1), counts, prefix))
    levels = levels[least_words - 1:]
    padded = [np.concatenate([g, np.full((len(g), DEPTH - g.shape[1]), -1, np.int32)], 1) for g, _, _ in levels]
    grams, counts = np.concatenate(padded), np.concatenate([c for _, c, _ in levels])
    own_range = _range_of(np.concatenate([h for _, _, h in levels]), ranges)
    by_range = np.argsort(own_range, kind="stable")
    ends = np.cumsum(np.bincount(own_range, minlength=ranges))
    for number, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if start < end:
            own = by_range[start:end]
            used, compact = np.unique(grams[own], return_inverse=True)
            compact = compact.reshape(-1, DEPTH).astype(np.int32) - (1 if used[0] < 0 else 0)
            yield number, CountTransducer.from_unsorted([words[i] for i in used.tolist() if i >= 0], compact, counts[own])


def _shards(ranges: int, least_words: int, most_words: int, words_of_filter=None, bits: int = 0):
    """Count the phrases of each task's texts in shards of bounded size; one automaton for each prefix range leaves.

    With the words of a filter only phrases whose pairs are all in it are counted.
    """
    def run(batches):
        from collections import defaultdict
        from itertools import count

        import numpy as np
        import pyarrow as pa

        table = bytearray(range(256))
        for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            table[byte] = byte + 32
        for byte in PIECE_ENDS:
            table[byte] = 10
        for byte in SPACES:
            table[byte] = 32
        table, shards = bytes(table), {}
        lit = words_of_filter.value if words_of_filter else None

        def emit(lang):
            numbers, parts, _ = shards.pop(lang)
            words = list(numbers)[2:]

            def frequent(hashes):
                bit = _bit_of(hashes, lang, bits)
                return (lit[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1

            if words:
                ids = np.concatenate(parts)
                for number, counted in _count(words, np.where(ids > 1, ids - 2, -1), ranges, least_words, most_words,
                                              frequent if lit is not None else None):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([number], pa.int32()), pa.array([counted.to_bytes()], pa.binary())],
                        names=["lang", "range", "counts"])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                texts = defaultdict(list)
                for lang, text in zip(*[c.to_pylist() for c in batch.slice(start, 512).columns]):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    if lang not in shards:
                        numbers = defaultdict(count().__next__)
                        numbers[b""], numbers[b"\n"]
                        shards[lang] = [numbers, [], 0]
                    numbers, parts, _ = shards[lang]
                    split = (b"\n".join(own) + b"\n").translate(table).replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(numbers.__getitem__, split), np.int64, len(split))
                    parts.append(ids[ids > 0])
                    shards[lang][2] += len(parts[-1])
                    if shards[lang][2] >= SHARD_WORDS:
                        yield from emit(lang)
                # many languages at once must not add up
                while sum(s[2] for s in shards.values()) > 2 * SHARD_WORDS:
                    yield from emit(max(shards, key=lambda lang: shards[lang][2]))
        for lang in list(shards):
            yield from emit(lang)

    return run


def _pair_bits(bits: int):
    """The bits of the filter that the pairs of words in automata set."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                automaton = CountTransducer.from_bytes(counts)
                grams, _ = automaton.phrases()
                pairs = grams[(grams[:, 1] >= 0) & (grams[:, 2] < 0), :2]
                if len(pairs):
                    hashes = _word_hashes(automaton.words)
                    found = np.unique(_bit_of(_longer(hashes[pairs[:, 0]], hashes[pairs[:, 1]]), lang, bits))
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["bit"])

    return run


def _unite(least: int):
    """Unite the automata of a language and prefix range; what is frequent, and the number of all words, leave."""
    def run(batches):
        import pyarrow as pa

        def leave(key, parts):
            whole = parts[0] if len(parts) == 1 else CountTransducer.union(parts)
            words = int(whole.levels[0][2].sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([words], pa.int64()),
                 pa.array([whole.at_least(least).to_bytes()], pa.binary())], names=["lang", "range", "words", "counts"])

        key, parts, pending = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang, number, counts = (c[i].as_py() for c in batch.columns)
                if key is not None and (lang, number) != key:
                    yield leave(key, parts)
                    parts, pending = [], 0
                key = (lang, number)
                parts.append(CountTransducer.from_bytes(counts))
                if len(parts) > 1:
                    pending += sum(len(w) for _, w, _ in parts[-1].levels)
                if pending > PENDING:
                    parts, pending = [CountTransducer.union(parts)], 0
        if key is not None:
            yield leave(key, parts)

    return run


def _phrases(ranges: int):
    """Each frequent phrase of an automaton, and for those of two and more words the parts they are cut into."""
    def run(batches):
        import pyarrow as pa

        names = ["lang", "phrase", "a", "k", "right", "part", "range"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                automaton = CountTransducer.from_bytes(counts)
                grams, weights = automaton.phrases()
                for start in range(0, len(grams), 4096):
                    out = []
                    for own, a in zip(grams[start:start + 4096].tolist(), weights[start:start + 4096].tolist()):
                        words = [automaton.words[i] for i in own if i >= 0]
                        phrase = b" ".join(words).decode()
                        for k in range(1, len(words)):
                            for right, part in ((False, words[:k]), (True, words[k:])):
                                part = b" ".join(part)
                                out.append((lang, phrase, a, k, right, part.decode(), part_range(part, ranges)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return run


def _look_up(batches):
    """Compose the parts of a range with its automaton, which comes first."""
    import pyarrow as pa

    key, automaton = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            rows = batch.slice(start, 4096).to_pylist()
            at = 0
            while at < len(rows):
                own = (rows[at]["lang"], rows[at]["range"], rows[at]["lane"])
                end = at
                while end < len(rows) and (rows[end]["lang"], rows[end]["range"], rows[end]["lane"]) == own:
                    end += 1
                asked, at = rows[at:end], end
                if own != key:
                    key, automaton = own, None
                if asked[0]["counts"] is not None:
                    automaton, asked = CountTransducer.from_bytes(asked[0]["counts"]), asked[1:]
                if asked:
                    found = automaton.compose([r["part"].encode() for r in asked])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["lang"] for r in asked]), pa.array([r["phrase"] for r in asked]),
                        pa.array([r["a"] for r in asked], pa.int64()), pa.array([r["k"] for r in asked], pa.int32()),
                        pa.array([r["right"] for r in asked], pa.bool_()), pa.array(found, pa.int64())],
                        names=["lang", "phrase", "a", "k", "right", "count"])


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int | None = 2000, filter_bits: int = 25,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `PIECE_ENDS` and those into words at spaces and tabs. Candidates are
    phrases of 2 to 4 words that occur `least` times (a) within pieces of a language, overlaps included. Cut after k words, the
    parts occur l and r times, and the score is floor(2000000 a / (l + r)); the cut with the lowest score counts, the
    smallest k on ties. A candidate inside a longer one, dropped or not, that occurs at least `covered` percent as often is
    dropped. n is the number of words of the language. `top` phrases of each language stay (None: all), by score and a
    descending, then the phrase in byte order.

    Tasks count phrases in shards of bounded size, each an acyclic automaton built from the sorted phrases and cut
    by prefix range: the hash of the first three words, so that a word or pair of words that begins a third of all phrases
    is spread over many ranges. Ranges grow with the texts. The automata of a range are united one after the other, weights
    added, and only frequent phrases leave; parts of a frequent phrase are frequent themselves, so nothing is lost.
    Words and pairs are counted first. A filter of 2^filter_bits bits, of that size whatever the corpus, then tells the
    tasks which pairs may be frequent, and phrases of three and four words are counted where all their pairs are; a full
    filter would cost time, not results.
    The parts are sent to their ranges, in lanes where many ask for one, and composed with the automaton there.

    Null texts count as empty, null languages as `und`. Repeated rows count again; ids and other columns are not looked at.
    An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    own = ["lang", "range"]

    def united_of(counts: DataFrame, least: int) -> DataFrame:
        return counts.repartition(*own).sortWithinPartitions(*own).mapInArrow(
            _unite(least), "lang string, range int, words long, counts binary")

    counted = "lang string, range int, counts binary"
    short = materialise(united_of(rows.mapInArrow(_shards(ranges, 1, 2), counted), least), "words-and-pairs")
    filled = short.select("lang", "counts").mapInArrow(_pair_bits(filter_bits), "bit long").select(
        F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("value")).groupBy(
        "word").agg(F.expr("bit_or(value)").alias("value"))
    lit = docs.sparkSession.sparkContext.broadcast(_filter_words(filled, filter_bits))
    long = united_of(rows.mapInArrow(_shards(ranges, 3, DEPTH, lit, filter_bits), counted), least)
    united = materialise(united_of(short.select(*own, "counts").unionByName(long.select(*own, "counts")), 1), "united")
    totals = short.groupBy("lang").agg(F.sum("words").alias("n"))
    parts = materialise(united.select("lang", "counts").mapInArrow(
        _phrases(ranges), "lang string, phrase string, a long, k int, right boolean, part string, range int"), "parts")
    lanes = materialise(parts.groupBy(*own).agg(F.ceil(F.count("*") / LANE_ROWS).cast("int").alias("lanes")), "lanes")
    asked = parts.join(lanes, own).withColumn("lane", F.pmod(F.xxhash64("phrase", "k"), "lanes").cast("int")).select(
        *own, "lane", "phrase", "a", "k", "right", "part", F.lit(None).cast("binary").alias("counts"))
    none = {c: F.lit(None).cast(t) for c, t in asked.dtypes if c in ("phrase", "a", "k", "right", "part")}
    answering = united.join(lanes, own).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumns(
        none).select(*asked.columns)
    lane = [*own, "lane"]
    found = answering.unionByName(asked).repartition(*lane).sortWithinPartitions(
        *lane, F.col("phrase").asc_nulls_first()).mapInArrow(
        _look_up, "lang string, phrase string, a long, k int, right boolean, count long")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(~F.col("right"), F.col("count"))).alias("l"),
                                                         F.max(F.when(F.col("right"), F.col("count"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r) as long)"))
    scored = materialise(cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")), "scored")
    words = F.split("phrase", " ")
    inner = scored.where(F.size(words) > 2).withColumn("words", words).withColumn("inner", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.concat_ws(" ", F.slice("words", i, m)))))))
    inner = inner.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))


def oracle(least: int = 30, covered: int = 80, top: int = 2000) -> str:
    """The same for DuckDB, over a table `documents`."""
    return rf"""
    WITH pieces AS MATERIALIZED (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    grams AS (
      SELECT lang, m AS size, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (
        SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS s(m)
        WHERE len(w) >= m)),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
    cuts AS (
      SELECT c.lang, c.size, c.phrase, c.a, k, p.a AS l, q.a AS r,
             ((2000000::HUGEINT * c.a) // (p.a::HUGEINT + q.a))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c
      JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ')
      JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:], ' ')),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM (
        SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM c, (VALUES (2), (3)) AS s(m) WHERE size > m)
      GROUP BY ALL),
    kept AS (
      SELECT t.* FROM lowest t LEFT JOIN inside i ON i.lang = t.lang AND i.phrase = t.phrase
      WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < {covered}::HUGEINT * t.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
