"""A minimal perfect hash over 32-byte digests, built level by level with numpy.

At each level every open key hashes into an array of twice as many slots; keys alone in
their slot are settled there, the others go to the next level. A key's index is the rank
of its slot among all settled ones, so n keys take exactly the indexes 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from cladeflow.llm.common import mix

SPREAD = 2.0


def words(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys[:, 0] + np.uint64(level) * (keys[:, 1] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """levels: one boolean array for each level; ranks: settled keys before each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(x) - x for x in levels]
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = max(2, int(SPREAD * len(keys)))
            at = _slots(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; any index, or -1, for keys that are not members."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _slots(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], dtype="<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        sizes = np.frombuffer(data, dtype="<i8", count=n, offset=8)
        at, levels = 8 * (n + 1), []
        for size in sizes.tolist():
            step = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=step, offset=at), count=size).astype(bool))
            at += step
        return cls(levels)
