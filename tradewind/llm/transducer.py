"""Acyclic automata over words that carry the count of each phrase: built from sorted phrases, united, composed."""

from __future__ import annotations


def _order(grams):
    """The order of rows of word numbers (-1 behind the last word), a phrase before its extensions."""
    import numpy as np

    high, low = _packed(grams)
    return np.lexsort((low, high))


def _packed(grams):
    import numpy as np

    wide = np.full((len(grams), 4), -1, np.int64)
    wide[:, :grams.shape[1]] = grams
    wide += 1
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


class CountTransducer:
    """A deterministic acyclic automaton whose input are the words of a phrase and whose output is the phrase's count.

    States are shared by all phrases with the same beginning and stored level by level: level d has one arc for each
    beginning of d words, sorted by the state it leaves and its word. An arc's weight is the count of the phrase that ends
    with it; 0 where none ends.
    """

    DEPTH = 4

    def __init__(self, words: list[bytes], levels: list[tuple]):
        self.words, self.levels = words, levels  # levels: (parent, word, weight) arrays

    @classmethod
    def from_sorted(cls, words: list[bytes], grams, weights) -> CountTransducer:
        """From distinct phrases in order, as rows of word numbers with -1 behind the last word; words in byte order."""
        import numpy as np

        levels, new, at = [], np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        if len(grams):
            new[0] = True
        for d in range(grams.shape[1]):
            new[1:] |= grams[1:, d] != grams[:-1, d]
            begins = new & (grams[:, d] >= 0)
            arc = np.cumsum(begins) - 1
            weight = np.zeros(int(begins.sum()), np.int64)
            ends = (grams[:, d] >= 0) & ((grams[:, d + 1] < 0) if d + 1 < grams.shape[1] else True)
            weight[arc[ends]] = weights[ends]
            levels.append((at[begins], grams[begins, d].astype(np.int64), weight))
            at = arc
        return cls(words, levels)

    @classmethod
    def from_unsorted(cls, words: list[bytes], grams, weights) -> CountTransducer:
        """The same from rows in any order; weights of equal phrases are added."""
        import numpy as np

        order = _order(grams)
        grams, weights = grams[order], weights[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]).any(axis=1)
        total = np.add.reduceat(weights, np.flatnonzero(first)) if len(grams) else weights
        return cls.from_sorted(words, grams[first], total)

    def phrases(self):
        """(rows of word numbers, counts) of all phrases, level by level."""
        import numpy as np

        grams, weights, before = [], [], None
        for d, (parent, word, weight) in enumerate(self.levels):
            own = np.full((len(word), self.DEPTH), -1, np.int32)
            if d:
                own[:, :d] = before[parent, :d]
            own[:, d] = word
            grams.append(own[weight > 0])
            weights.append(weight[weight > 0])
            before = own
        return np.concatenate(grams), np.concatenate(weights)

    @classmethod
    def union(cls, parts: list[CountTransducer]) -> CountTransducer:
        """One automaton with the phrases of all, their counts added."""
        import numpy as np

        words = sorted(set().union(*[p.words for p in parts]))
        number = {w: i for i, w in enumerate(words)}
        grams, weights = [], []
        for part in parts:
            own, weight = part.phrases()
            new = np.array([*map(number.__getitem__, part.words), -1], np.int32)  # the last stands for "no word"
            grams.append(new[own])
            weights.append(weight)
        return cls.from_unsorted(words, np.concatenate(grams), np.concatenate(weights))

    def at_least(self, least: int) -> CountTransducer:
        """Only the phrases with that count, and the words in them."""
        import numpy as np

        grams, weights = self.phrases()
        grams, weights = grams[weights >= least], weights[weights >= least]
        used = np.unique(grams[grams >= 0])
        new = np.full(len(self.words) + 1, -1, np.int32)
        new[used] = np.arange(len(used))
        return self.from_unsorted([self.words[i] for i in used.tolist()], new[grams], weights)

    def compose(self, phrases: list[bytes]):
        """The count of each phrase (words joined by single spaces), 0 where the automaton accepts none.

        The phrases run through the automaton side by side, a level at a time.
        """
        import numpy as np

        number = {w: i for i, w in enumerate(self.words)}
        split = [p.split(b" ") for p in phrases]
        grams = np.full((len(phrases), self.DEPTH + 1), -1, np.int64)
        for i, own in enumerate(split):
            for d, w in enumerate(own[:self.DEPTH + 1]):
                grams[i, d] = number.get(w, -2)
        counts, state, going = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64), np.arange(len(phrases))
        base = len(self.words) + 1
        for d, (parent, word, weight) in enumerate(self.levels):
            keys, asked = parent * base + word, state[going] * base + grams[going, d]
            at = np.searchsorted(keys, asked)
            found = (grams[going, d] >= 0) & (at < len(keys))
            found[found] = keys[at[found]] == asked[found]
            going, at = going[found], at[found]
            state[going] = at
            ends = grams[going, d + 1] == -1
            counts[going[ends]] = weight[at[ends]]
        return counts

    def to_bytes(self) -> bytes:
        """The words, then for each level the arcs of every state, their words and their weights; compressed."""
        import numpy as np
        import zstandard

        joined, parts, above = b"\n".join(self.words), [], 1
        wide = any(len(w) and int(w.max()) >= 2 ** 32 for _, _, w in self.levels)
        for parent, word, weight in self.levels:
            parts += [np.bincount(parent, minlength=above).astype(np.uint32), word.astype(np.uint32),
                      weight.astype(np.uint64 if wide else np.uint32)]
            above = len(word)
        head = np.array([len(self.words), len(joined), wide, *[len(w) for _, w, _ in self.levels]], np.int64)
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), joined, *[p.tobytes() for p in parts]]))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        n, size, wide, *arcs = np.frombuffer(raw, np.int64, 3 + cls.DEPTH).tolist()
        at = 8 * (3 + cls.DEPTH)
        words = raw[at:at + size].split(b"\n") if n else []
        at, above, levels = at + size, 1, []

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(raw, kind, count, at).astype(np.int64)
            at += got.size * np.dtype(kind).itemsize
            return got

        for count in arcs:
            parent = np.repeat(np.arange(above), take(np.uint32, above))
            levels.append((parent, take(np.uint32, count), take(np.uint64 if wide else np.uint32, count)))
            above = count
        return cls(words, levels)
