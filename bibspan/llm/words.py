"""Words of whole texts as 64-bit hashes, found and hashed by numpy over the UTF-8 bytes.

Separators are ASCII bytes, so bytes of longer characters always belong to words and no
text has to be decoded.  A-Z count as a-z.  A word's hash is a polynomial over its bytes,
taken from one running sum; two words of equal bytes have equal hashes wherever they stand.
"""

import sys

import numpy as np
from pyspark import cloudpickle

from bibspan.llm.common import PIECE_BYTES

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def separators(kind: str) -> np.ndarray:
    """`space`: ASCII white space separates; `alphanumeric`: all ASCII but letters and digits."""
    found = np.zeros(256, dtype=bool)
    if kind == "space":
        found[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alphanumeric":
        found[:128] = [not chr(b).isalnum() for b in range(128)]
    else:
        raise ValueError(kind)
    return found


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    v = values.copy()
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class WordHasher:
    """Hashes the words of byte texts; keeps its tables of powers."""

    def __init__(self, kind: str):
        self.is_word = ~separators(kind)
        fold = np.arange(256)
        fold[65:91] += 32
        self.code = mixed(fold.astype(np.uint64) + np.uint64(1))
        self._grow(PIECE_BYTES + 4096)

    def _grow(self, size: int) -> None:
        ones = np.full(size, _BASE)
        ones[0] = 1
        self.power = np.cumprod(ones, dtype=np.uint64)
        ones[1:] = _INVERSE
        self.back = np.cumprod(ones, dtype=np.uint64)

    def _piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) >= len(self.power):
            self._grow(len(data) + 1)
        inside = self.is_word[data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[starts] = False
        begin = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[starts[starts > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.code[data] * self.power[: len(data)], out=total[1:])
        value = (total[end] - total[begin]) * self.back[begin]
        return mixed(value), begin, end

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each text where its words start."""
        hashes, places = self.located(data, offsets)
        return hashes, np.searchsorted(places, offsets)

    def located(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the byte where each word starts."""
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(data):
            stop = min(at + PIECE_BYTES, len(data))
            if stop < len(data):
                stop = self._cut(data, offsets, at, stop)
            inner = offsets[(offsets >= at) & (offsets < stop)] - at
            found, begin, _ = self._piece(data[at:stop], inner)
            hashes.append(found)
            places.append(begin + at)
            at = stop
        return np.concatenate(hashes), np.concatenate(places)

    def _cut(self, data, offsets, at, stop) -> int:
        """The last start of a text, or else a separator: a place where no word goes on."""
        text = offsets[(offsets > at) & (offsets <= stop)]
        if len(text):
            return int(text[-1])
        gap = np.flatnonzero(~self.is_word[data[at:stop]])
        if len(gap):
            return at + int(gap[-1]) + 1
        follows = offsets[offsets > stop]
        end = int(follows[0]) if len(follows) else len(data)
        gap = np.flatnonzero(~self.is_word[data[stop:end]])
        return stop + int(gap[0]) + 1 if len(gap) else end


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words of one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value = value * _STEP + hashes[k : k + n]
    return mixed(value + np.uint64(width))


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of the words of each span; without ends, a span ends where the next one starts, the last with the words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = len(hashes) + 1
    power, back = np.full(size, _STEP), np.full(size, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.zeros(size, dtype=np.uint64)
    np.cumsum(hashes * power[1:], out=total[1:])
    ends = np.append(starts[1:], len(hashes)) if ends is None else ends
    return mixed((total[ends] - total[starts]) * back[starts])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
