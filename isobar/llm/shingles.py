"""Hashed word shingles of whole texts, a batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Texts are hashed in windows of about this many bytes, cut at white space.
WINDOW = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n - 1`` modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, WINDOW), base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 4 * WINDOW:
            _powers[int(base)] = known
    return known[:n]


def _window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start, and their hashes."""
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64),
                           np.cumsum(_BYTES[data] * _power(BASE, len(data)), dtype=np.uint64)))
    return starts, mix((sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts])


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. A-Z are lower-cased.

    Words are the maximal runs of characters other than the space and the control characters
    9 to 13. A null text has none.
    """
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # a word goes on: up to its end
            rest = np.flatnonzero(_SPACE[data[end:end + WINDOW]])
            end += int(rest[0]) if len(rest) else len(data[end:end + WINDOW])
        first, found = _window(data[at:end])
        starts.append(first + at)
        hashes.append(found)
        at = end
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
            np.bincount(text, minlength=len(texts)))


def _chained(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash of the ``size`` word hashes from each place on, in their order."""
    value = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        value = value * STEP + words[at + k]
    return mix(value)


def shingle_sets(texts: Sequence[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of all texts: the number of the text and the hash, sorted by both.

    A shingle is ``size`` words in a row; a text of fewer words has one, its whole sequence; a text
    without words has none.
    """
    words, count = word_hashes(texts)
    first = np.cumsum(count) - count
    held = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    ends = np.cumsum(held)
    value = np.empty(held.sum(), dtype=np.uint64)
    long = np.repeat(count >= size, held)
    nth = np.arange(len(value)) - np.repeat(ends - held, held)
    value[long] = _chained(words, (np.repeat(first, held) + nth)[long], size)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        value[ends[short] - 1] = _chained(words, first[short], n)
    for end, n in zip(ends[held > 1].tolist(), held[held > 1].tolist()):
        value[end - n:end].sort()
    text = np.repeat(np.arange(len(count)), held)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
