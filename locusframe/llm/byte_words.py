"""Words, their hashes and byte counts of many texts at once, on the bytes of a whole slice of texts.

A word's hash is a difference of prefix sums of ``byte * base^position`` (modulo 2^64), divided by the power at the
word's start. So the hash of any prefix or suffix of a word costs a lookup, and no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

from locusframe.llm.common import per_process

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Tables of powers grow by so many entries; doubled, those for a slice of a little over 1 MB took 32 MB of every worker.
POWER_STEP = 1 << 17


def _power_tables(n: int) -> list[np.ndarray]:
    """base^i and base^-i for i < n, kept by the process for the largest n so far."""
    tables = per_process("words", ("powers",), lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(tables[0]) < n:
        for k, factor in enumerate((BASE, _INVERSE)):
            steps = np.full(-(-n // POWER_STEP) * POWER_STEP, factor, np.uint64)
            steps[0] = 1
            tables[k] = np.cumprod(steps)
    return tables


class ByteText:
    """The bytes of texts set one after another, each followed by a line end."""

    def __init__(self, texts: list[str], lower: bool):
        self._set([(t.lower() if lower else t).encode("utf-8", "replace") for t in texts])

    @classmethod
    def of(cls, parts: list[bytes]) -> "ByteText":
        """The same of texts that are bytes already."""
        out = cls.__new__(cls)
        out._set(parts)
        return out

    def _set(self, parts: list[bytes]) -> None:
        self.bytes = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        powers, self._inverse = _power_tables(len(self.bytes) + 1)
        self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * powers[: len(self.bytes)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64 bit hashes of the spans; equal spans have equal hashes."""
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def words(self, is_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes for which the table ``is_part`` (one entry per byte value) holds."""
        part = is_part[self.bytes]
        edge = np.flatnonzero(np.diff(part.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return edge[0::2], edge[1::2]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text that holds each byte position."""
        return np.searchsorted(self.starts, positions, side="right") - 1


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


# Letters and digits of ASCII, and every byte of longer characters.
WORD_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# Everything but ASCII white space.
INK_BYTES = ~byte_set((0x09, 0x0D), (0x20, 0x20))
