"""A minimal perfect hash function over distinct 64-bit keys, by levels of bitmaps."""

from __future__ import annotations

ROOM = 1.6  # bits of a level for each key that is left


def _mixed(keys, level: int):
    """The keys as unsigned numbers, mixed differently for every level."""
    import numpy as np

    x = keys.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 2 ** 64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n keys, each used once. A key takes the first level on which no other key has its bit.

    A key that was not among them gets any slot or -1, so callers keep the keys by slot and compare.
    """

    def __init__(self, levels: list):
        import numpy as np

        self.levels = levels  # arrays of 0 and 1
        self.bases = np.cumsum([0, *[int(bits.sum()) for bits in levels]])
        self.ranks = [np.cumsum(bits) - 1 for bits in levels]

    @classmethod
    def build(cls, keys) -> PerfectHash:
        import numpy as np

        levels, left = [], np.asarray(keys, np.int64)
        if len(np.unique(left)) != len(left):
            raise ValueError("the keys must be distinct")
        while len(left):
            size = int(len(left) * ROOM) + 8
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys):
        import numpy as np

        keys = np.asarray(keys, np.int64)
        slots, open_at = np.full(len(keys), -1), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mixed(keys[open_at], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            slots[open_at[hit]] = self.bases[level] + self.ranks[level][at[hit]]
            open_at = open_at[~hit]
        return slots

    def to_bytes(self) -> bytes:
        """The number of levels, their sizes, then their bits, eight a byte."""
        import numpy as np

        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(bits.astype(np.uint8)).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        import numpy as np

        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(np.int64))
            at += len(packed)
        return cls(levels)
