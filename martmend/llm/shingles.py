"""Sets of hashed word shingles, computed for whole Arrow batches with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of word and shingle hashes (fixed values of this design).
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Bytes of text that are hashed at once; a longer word is hashed whole.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word: differences of prefix sums, moved to exponent 0 by the inverse of the base."""
    out = np.empty(len(start), np.uint64)
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT)))
        a, b = int(start[i]), int(end[j - 1])
        power = np.full(b - a, BASE, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        back = np.full(b - a, inverse, np.uint64)
        back[:1] = 1
        np.multiply.accumulate(back, out=back)
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * back[start[i:j] - a]
        i = j
    return mix(out + (end - start).astype(np.uint64) * STEPS[4])


def sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of k words, sorted; with fewer words, one of all; without words, none.

    Words are runs of characters other than the ASCII blanks 9 to 13 and 32; A-Z count as a-z. Null is the empty text.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (SEGMENT << 2), "right")) - 1)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[i] : offsets[j]] if offsets[j] > offsets[i] else np.zeros(0, np.uint8)
        yield from _sets(data, offsets[i : j + 1] - offsets[i], k)
        i = j


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.ones(len(data) + 1, bool)  # a byte before which no word of the same text goes on
    fresh[1:-1] = ~word[:-1]
    fresh[offsets] = True
    start = np.flatnonzero(word & fresh[:-1])
    over = np.ones(len(data), bool)
    over[:-1] = ~word[1:]
    over |= _marks(len(data), offsets)
    end = np.flatnonzero(word & over) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes = _word_hashes(lower, start, end)
    first = np.searchsorted(start, offsets)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for step in range(k):
        rolled += hashes[step : len(hashes) - k + 1 + step] * STEPS[step]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _marks(n: int, offsets: np.ndarray) -> np.ndarray:
    """True at the last byte of each text."""
    out = np.zeros(n, bool)
    at = offsets[1:] - 1
    out[at[(at >= 0)]] = True
    return out
