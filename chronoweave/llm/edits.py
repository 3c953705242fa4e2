"""Whether lines are within a number of edits, for many pairs at once."""

from __future__ import annotations

import numpy as np

#: Pairs that go together at most, and characters of the longest line times pairs.
_PAIRS, _CELLS = 2048, 1 << 21
#: After so many characters pairs that are decided are left out.
_EVERY = 16


def within(first: list[str], second: list[str], allowed: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair is ``allowed`` or less.

    Bit-parallel over the diagonals in reach, as ``banded_distance``, with the words of a bit vector of many pairs
    in one array. A path of ``allowed`` edits leaves the diagonals of both ends by half of what is over at most.
    """
    sizes = np.array([[len(x) for x in first], [len(x) for x in second]], np.int64).reshape(2, -1)
    ahead, shorter = np.abs(sizes[0] - sizes[1]), sizes.min(axis=0)
    allowed = np.asarray(allowed, np.int64)
    beside = (allowed - ahead) // 2
    width = ahead + 2 * beside + 1
    found = ahead <= allowed
    order = np.flatnonzero(found & (shorter > 0))
    found[(shorter == 0) & (ahead > allowed)] = False
    words = -(-width // 64)
    order = order[np.lexsort((shorter[order], words[order]))]
    start = 0
    while start < len(order):
        most = min(_PAIRS, max(1, _CELLS // int(shorter[order[start]])))
        some = order[start : start + most]
        some = some[(words[some] == words[some[0]]) & (shorter[some] <= 2 * shorter[some[0]] + 64)]
        swap = sizes[0, some] < sizes[1, some]
        a = [second[k] if s else first[k] for k, s in zip(some.tolist(), swap.tolist(), strict=True)]
        b = [first[k] if s else second[k] for k, s in zip(some.tolist(), swap.tolist(), strict=True)]
        found[some] = _banded(a, b, ahead[some], beside[some], allowed[some], int(words[some[0]]))
        start += len(some)
    return found


def _codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)


def _banded(a: list[str], b: list[str], ahead: np.ndarray, beside: np.ndarray, allowed: np.ndarray, words: int) -> np.ndarray:
    """For pairs in the order of the sizes of ``b``, none of which is longer than its ``a``."""
    n, bits = len(a), 64 * words
    size_a, size_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    codes_a, codes_b = _codes(a), _codes(b)
    most = int(max(codes_a.max(), codes_b.max()))
    kind = np.uint8 if most < 254 else np.uint16 if most < 65534 else np.uint32
    none = np.iinfo(kind).max
    longest = int(size_b.max())
    over, under = np.full((n, longest + bits), none, kind), np.full((n, longest), none - 1, kind)
    row = np.repeat(np.arange(n), size_a)
    over[row, np.arange(len(codes_a)) - np.repeat(np.cumsum(size_a) - size_a, size_a) + beside[row]] = codes_a
    row = np.repeat(np.arange(n), size_b)
    under[row, np.arange(len(codes_b)) - np.repeat(np.cumsum(size_b) - size_b, size_b)] = codes_b
    full, up = _below(ahead + 2 * beside + 1, words), _below(beside, words)
    up = full & ~up
    down, distance = np.zeros_like(up), ahead.copy()
    last = ahead + beside
    last_word, last_bit = last >> 6, (last & 63).astype(np.uint64)
    found, at = np.zeros(n, bool), np.arange(n)
    one = np.uint64(1)
    for column in range(longest):
        if column % _EVERY == 0 and column:
            going = (distance <= allowed) & (size_b > column)
            if going.sum() < 0.8 * len(going):
                found[at[distance <= allowed]] = True  # of those that end here; the others are decided below
                found[at[going]] = False
                at, over, under, full, up, down = at[going], over[going], under[going], full[:, going], up[:, going], down[:, going]
                distance, allowed, size_b, last_word, last_bit = (x[going] for x in (distance, allowed, size_b, last_word, last_bit))
                if not len(at):
                    return found
        match = np.packbits(over[:, column : column + bits] == under[:, column : column + 1], axis=1, bitorder="little").view(np.uint64).T & full
        zero = (_plus(match & up, up) ^ up | match | down) & full
        right = down | full & ~(zero | up)
        left = zero & up
        end = zero[0] if words == 1 else zero[last_word, np.arange(len(at))]
        ended = np.searchsorted(size_b, column, side="right")
        distance[ended:] += 1 - (end[ended:] >> last_bit[ended:] & one).astype(np.int64)
        ahead_one = zero >> one
        if words > 1:
            ahead_one[:-1] |= zero[1:] << np.uint64(63)
        up = left | full & ~(ahead_one | right)
        down = ahead_one & right
    found[at] = distance <= allowed
    return found


def _below(counts: np.ndarray, words: int) -> np.ndarray:
    """(words, pairs): the lowest ``counts`` bits set."""
    bits = np.clip(counts[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    return np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of numbers of several words, the least word first."""
    total = a + b
    carry = total[0] < a[0]
    for k in range(1, len(a)):
        over = total[k] < a[k]
        total[k] += carry
        carry = over | (total[k] < carry)
    return total
