"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, slices, vocabulary_path, worker_cache

#: Fixed value of the byte-level pre-tokeniser: contractions, words, numbers, other runs, white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_LENGTH, CACHED_WORDS = 64, 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [], 0
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(256 + extra))
            extra += 1
    return letters


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when always the lowest-ranked adjacent pair (leftmost on ties) is merged."""
    import heapq

    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:  # the pair is gone
            continue
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        left -= 1
    return left


class TokenCounter:
    """Counts tokens of texts as the vocabulary file defines them; remembers the counts of short words."""

    def __init__(self, path: str):
        import json
        import re

        import regex

        spec = json.load(open(path, encoding="utf-8"))
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i
                      for i, m in enumerate(spec["model"]["merges"])}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.letters = byte_letters()
        self.pieces = regex.compile(PIECES)
        # a single space between two other characters always begins a new piece
        self.joints = re.compile(r" (?<=\S )(?=\S)")
        self.known: dict[str, int] = {}
        self.known_pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        n = self.known_pieces.get(piece)
        if n is None:
            n = count_merged([self.letters[b] for b in piece.encode()], self.ranks)
            self.remember(self.known_pieces, piece, n)
        return n

    @staticmethod
    def remember(known: dict[str, int], word: str, n: int) -> None:
        if len(word) <= CACHED_LENGTH:
            if len(known) >= CACHED_WORDS:
                known.clear()
            known[word] = n

    def words(self, words: list[str]) -> int:
        """words: the text cut at its joints; all but the first stand after a space."""
        known, total, first = self.known, 0, True
        for word in words:
            n = known.get(word) if not first else None
            if n is None:
                n = sum(map(self.piece, self.pieces.findall(word if first else " " + word)))
                if not first:
                    self.remember(known, word, n)
                first = False
            total += n
        return total

    def count(self, text: str) -> int:
        if not self.special or "<" not in text and not self.special.search(text):
            return self.words(self.joints.split(text)) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.words(self.joints.split(p)) for p in parts if p)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Byte-level pair merging as the vocabulary file says: a text is cut into pieces, each byte of a piece is a
    symbol, and the lowest-ranked adjacent pair is merged until none is left. A heap holds the pairs, a linked
    list the symbols, so a piece of n bytes costs n log n however long it is. Only counts leave the merger.
    Special strings inside a text count as one token each. There is no shuffle; each task reads its own rows.

    Null texts count as empty: 0 bytes, 0 tokens. Rows that repeat an id, null ids and empty tables need no
    care: a row in is a row out. Columns other than id and text are not looked at.
    """
    rows = id_and_text(docs, id_col, text_col)
    ids = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cache, path = worker_cache(), vocabulary_path(vocabulary)
        if ("counter", path) not in cache:
            cache["counter", path] = TokenCounter(path)
        counter = cache["counter", path]
        for batch in slices(batches):
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, f"doc_id {ids}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
