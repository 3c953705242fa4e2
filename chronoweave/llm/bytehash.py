"""Tokens and 64-bit hashes of whole texts, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SPACE, WORD, MARK = 0, 1, 2
SEGMENT = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[128:] = WORD
_CLASS[[ord(c) for c in "0123456789_"]] = WORD
_CLASS[ord("a") : ord("z") + 1] = WORD
_CLASS[ord("A") : ord("Z") + 1] = WORD
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tables[0], tables[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut before white space; a longer word stays whole."""
    start = 0
    while len(data) - start > size:
        cut = _BLANK.search(data, start + size)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and for each line the number of its first word.

    Words are parted by one blank or line feed each, and every line has a word.
    """
    codes = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero((codes == 32) | (codes == 10)), len(codes))
    starts = np.append(0, ends[:-1] + 1)
    first = np.append(0, np.flatnonzero(codes[ends[:-1]] == 10) + 1)
    forward, backward = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * forward[: len(codes)], out=sums[1:])
    return mix(mix((sums[ends] - sums[starts]) * backward[starts])), first


def token_hashes(data: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes and classes of the tokens of ``data`` in order, and hashes of their leading bytes.

    A token is a run of word bytes (letters, digits, ``_`` and all bytes beyond ASCII) or of marks.
    For each length in ``prefixes`` an array holds the hashes of that many leading bytes of every
    token that is longer.
    """
    hashes, classes, heads = [], [], [[] for _ in prefixes]
    for piece in segments(data):
        codes = np.frombuffer(piece, np.uint8)
        if not len(codes):
            continue
        kinds = _CLASS[codes]
        bounds = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(codes)]))
        starts, ends = bounds[:-1], bounds[1:]
        real = kinds[starts] != SPACE
        starts, ends = starts[real], ends[real]
        forward, backward = _power_tables(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * forward[: len(codes)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * backward[starts]))
        classes.append(kinds[starts])
        for k, length in enumerate(prefixes):
            at = starts[(ends - starts > length) & (classes[-1] == WORD)]
            heads[k].append(mix((sums[at + length] - sums[at]) * backward[at] + np.uint64(length)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(hashes, np.uint64), join(classes, np.uint8), [join(x, np.uint64) for x in heads]
