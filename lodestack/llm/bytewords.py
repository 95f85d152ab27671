"""Words of whole Arrow batches as byte ranges, and checksums of their runs, without a Python object for each word.

A word is a run of digits, a to z after A-Z are lower-cased, and bytes of 128 and more, which are just the code points that
the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` takes. All work is over arrays of a batch; runs are looked at in blocks, so
that a very long text takes memory for its bytes and its words' places only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words whose checksums are looked for at once, and the length from which a word goes to zlib by itself.
BLOCK, LONG = 1 << 17, 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


#: crc32 by one byte
TABLE = _table()


class Words:
    """The words of a column of texts: ``data`` in lower case, ``starts`` and ``ends`` of each word in it, ``text`` the row of each."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())  # a null has no bytes, as it has equal offsets
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        self.rows = len(column)
        self.data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and len(column) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[:-1] = _IN_WORD[self.data]
        change = inside.copy()
        change[1:] ^= inside[:-1]
        # a text's end ends a word, even if the next text begins with one
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(self.data))])
        cut = cut[inside[cut] & inside[cut - 1]]
        change[cut] = True
        at = np.flatnonzero(change)
        opens = inside[at]
        self.starts = at[opens]
        ends = np.ones(len(at), dtype=bool)
        ends[:1] = False
        ends[1:][~inside[at[1:] - 1]] = False
        self.ends = at[ends]
        self.text = np.searchsorted(offsets[1:], self.starts, side="right")

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.rows)

    def _extended(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The checksum states, each continued by the bytes of a word."""
        length = self.ends[words] - self.starts[words]
        order = np.argsort(np.minimum(length, LONG + 1).astype(np.uint8), kind="stable")[::-1]
        first, size, now = self.starts[words][order], length[order], state[order]
        left = int(np.searchsorted(-size, -LONG, side="left"))  # longer ones lead
        for k in range(left):
            now[k] = zlib.crc32(self.data[first[k] : first[k] + size[k]].tobytes(), int(now[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        first, size, rest = first[left:], size[left:], now[left:]
        for p in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -p, side="left"))
            rest[:n] = TABLE[(rest[:n] ^ self.data[first[:n] + p]) & np.uint32(255)] ^ (rest[:n] >> np.uint32(8))
        out = np.empty_like(state)
        out[order] = now
        return out

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (row, crc32) of all runs of 1 to ``longest`` consecutive words of a text, joined by one space."""
        for a in range(0, len(self), BLOCK):
            words = np.arange(a, min(a + BLOCK, len(self)))
            state = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
            for n in range(longest):
                if n:
                    state = TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
                    go = words + n < len(self)
                    words, state = words[go], state[go]
                    same = self.text[words] == self.text[words + n]
                    words, state = words[same], state[same]
                state = self._extended(state, words + n)
                yield self.text[words], state ^ np.uint32(0xFFFFFFFF)
