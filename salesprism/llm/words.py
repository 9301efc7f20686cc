"""Words of UTF-8 texts as 64-bit hashes, worked out for whole blocks of bytes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alphanumeric() -> np.ndarray:
    """Value of each byte in a word of ASCII digits and letters (A-Z as a-z) and all beyond ASCII; 0 parts words."""
    value = mixed(np.arange(256, dtype=np.uint64) + _STEP) | np.uint64(1)
    value[65:91] = value[97:123]
    part = np.ones(256, bool)
    part[48:58] = part[65:91] = part[97:123] = part[128:] = False
    value[part] = 0
    return value


def spaced() -> np.ndarray:
    """Value of each byte in a word parted by ASCII white space, A-Z as a-z; 0 parts words."""
    value = mixed(np.arange(256, dtype=np.uint64) + _STEP) | np.uint64(1)
    value[65:91] = value[97:123]
    value[9:14] = value[32] = 0
    return value


def blocks(texts: pa.StringArray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most_bytes`` or a single longer text; rows without text count too."""
    begin, load = 0, 0
    for i, size in enumerate(np.diff(_offsets(texts))):
        if i > begin and load + size > most_bytes:
            yield begin, i
            begin, load = i, 0
        load += int(size) + 64
    if begin < len(texts):
        yield begin, len(texts)


def _offsets(texts: pa.StringArray) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return raw[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def raw_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the place where each text begins (one more for the last end)."""
    at = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


class Hasher:
    """Hashes of words by a polynomial over byte values, modulo 2**64, then mixed.

    Sums of ``value * STEP**place`` up to each place give the hash of any
    word as a difference of two sums, moved back by the inverse power.
    """

    def __init__(self, value: np.ndarray, chunk: int = CHUNK):
        self.value, self.chunk = value, chunk
        self._grow(chunk)

    def _grow(self, size: int) -> None:
        back = np.uint64(pow(int(_STEP), -1, 1 << 64))
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _STEP)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, back)]))

    def words(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word; a word ends where a text of ``begins`` starts."""
        found = [self._part(raw[a:b], begins[np.searchsorted(begins, a):np.searchsorted(begins, b)] - a, a)
                 for a, b in self._parts(raw)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])

    def _parts(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about ``chunk`` bytes that end behind a parting byte."""
        at = 0
        while at < len(raw):
            end = min(at + self.chunk, len(raw))
            if end < len(raw):
                stops = np.flatnonzero(self.value[raw[at:end]] == 0)
                if len(stops):
                    end = at + int(stops[-1]) + 1
                else:
                    while end < len(raw) and self.value[raw[end]] != 0:
                        end += 1
            yield at, end
            at = end

    def _part(self, raw: np.ndarray, begins: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        if len(raw) >= len(self.power):
            self._grow(len(raw))
        value = self.value[raw]
        inside = value != 0
        fresh = np.zeros(len(raw) + 1, bool)  # no word goes on over these places
        fresh[begins] = fresh[0] = fresh[-1] = True
        fresh[1:-1] |= ~inside[:-1]
        first = np.flatnonzero(inside & fresh[:-1])
        fresh[1:-1] |= ~inside[1:]
        last = np.flatnonzero(inside & fresh[1:]) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value * self.power[:len(raw)], out=sums[1:])
        code = (sums[last] - sums[first]) * self.inverse[first]
        return first + base, mixed(code + (last - first).astype(np.uint64) * _STEP)
