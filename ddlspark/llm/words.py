"""Words of texts as arrays, and hashes of any windows of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunks import PASS_BYTES, bytes_of
from .hashing import BYTE_VALUES, mixed, powers, slide

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, given by their bytes and where each text begins."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[begin] = True
        follows = np.zeros(len(data) + 1, bool)  # a word goes on from the byte before
        follows[1:-1] = inside[:-1] & inside[1:] & ~edge[1:-1]
        padded = np.append(inside, False)
        self.begin = np.flatnonzero(padded & ~follows)
        self.end = np.flatnonzero(np.append(False, inside) & ~follows)
        at = np.searchsorted(self.begin, begin)
        self.first, self.size = at[:-1], np.diff(at)  # of each text: its first word, and how many it has
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * up[:-1], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))
        up, self.down = powers(len(self.hash) + 1)
        self.sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=self.sums[1:])

    @classmethod
    def of(cls, texts: list[str | None], lower: bool = False) -> Words:
        return cls(*bytes_of(pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())), lower)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def hashes(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``length`` words from each word (or those ``at``) on; windows may leave their text but not the last one."""
        if at is None:
            at = np.arange(max(0, len(self.hash) - length + 1))
        return mixed((self.sums[at + length] - self.sums[at]) * self.down[at]) | np.uint64(1)

    def picked(self, length: int, window: int) -> np.ndarray:
        """First words of those ``length``-word windows that have the smallest hash in a ``window`` of words of one text."""
        if len(self.hash) < window:
            return np.zeros(0, np.int64)
        h, width = self.hashes(length), window - length + 1
        low = slide(h, width, np.minimum)
        leaving = np.zeros(len(self.hash) + 1, np.int32)
        np.add.at(leaving, np.maximum(self.first, self.first + self.size - window + 1), 1)
        np.add.at(leaving, self.first + self.size, -1)
        low[np.cumsum(leaving)[: len(low)] > 0] = 0
        pad = np.zeros(width - 1, np.uint64)
        return np.flatnonzero(slide(np.concatenate([pad, low, pad]), width, np.maximum) == h)


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about PASS_BYTES."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= PASS_BYTES):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to
