"""Dedup of fuzzy lines: SimHash, pigeonhole blocks of the line, edit similarity, connected groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import bytehash
from chronoweave.llm.bytehash import mix, word_hashes
from chronoweave.llm.components import connected_components
from chronoweave.llm.edits import within
from chronoweave.llm.idfilter import IdFilter
from chronoweave.llm.staging import Staging

SIMILARITY = 0.9
#: Only lines that meet and whose fingerprints differ in so many of 64 bits or fewer are compared; of under NEAR_CHARS characters, FEW_WORDS_NEAR.
NEAR = 20
NEAR_CHARS = 100
FEW_WORDS_NEAR = 24
#: Lines of fewer characters meet by segments, an exact way; lines of SHORT * SIMILARITY or more by blocks of words.
SHORT = 44
#: So many blocks for lines of fewer characters than the number beside it.
_BLOCKS = ((120, 4), (300, 6), (600, 8), (1000, 10), (1 << 62, 12))
#: How far from its even place a cut may lie, as a part of a block.
_REACH = 0.45
#: Lines with fewer words for each block are cut between any characters.
_WORDS_A_BLOCK = 2
#: Turns of hubs, as long as buckets of over SMALL lines are in several components; members of a bucket that are compared in one piece.
HUBS = 2
SMALL = 64
CHUNK = 1024
#: Texts of more characters are compared within a band.
BAND = 512
#: Lines of more characters are compared pair by pair, not with the other members of their bucket.
LONG = 1280
#: So many pairs of a bucket are compared before those whose lines are linked by now are left out.
TURN = 4096
#: So many rows are sent to the texts instead of the texts to them.
BROADCAST_ROWS = 200_000
_CHARS = 1 << 19


def normalise(line: str) -> str:
    """Lower case, with single blanks for white space and none at the ends."""
    return " ".join(line.lower().split())


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash, signed, of the distinct words of each line, given all words' hashes and where lines begin. No line may be empty."""
    line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
    # Lines in order, and in each the leading 40 bits of its words: one sort of whole numbers.
    order = np.argsort(line.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    hashes, line = hashes[order], line[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))
    hashes, first = hashes[new], np.searchsorted(line[new], np.arange(len(first)))
    counts = np.diff(np.append(first, len(hashes)))
    ones = _bit_counts(hashes, first, counts)
    return np.packbits(2 * ones.astype(np.int32) > counts[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def _bit_counts(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, 64): how many hashes of each line have each bit.

    Eight bits are counted at once, in the bytes of one number, over at most 255 hashes.
    """
    parts = -(-counts // 255)
    part_of = np.repeat(np.arange(len(first)), parts)
    begins = np.cumsum(parts) - parts
    starts = first[part_of] + 255 * (np.arange(len(part_of)) - begins[part_of])
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64)
    return ones if len(ones) == len(first) else np.add.reduceat(ones, begins, axis=0, dtype=np.int32)


#: Each byte with its bits as eight bytes of 0 or 1.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def letter_counts(plain: list[str]) -> np.ndarray:
    """How often each line has the characters of each of 16 kinds, modulo 16: four bits a kind, of one signed number."""
    sizes = np.array([len(x) for x in plain])
    kinds = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32) & 15
    counts = np.bincount(np.repeat(np.arange(len(plain)), sizes) * 16 + kinds, minlength=16 * len(plain)).reshape(-1, 16) & 15
    return np.bitwise_or.reduce(counts.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)


def letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how many characters two lines differ at least, whatever their order, given their ``letter_counts`` as unsigned numbers.

    An edit that replaces a character makes up for two, any other for one.
    """
    one, other = (x.view(np.uint8).reshape(-1, 8) for x in (a, b))
    low, high = (one & 15) - (other & 15) & 15, (one >> 4) - (other >> 4) & 15
    return (np.minimum(low, 16 - low) + np.minimum(high, 16 - high)).sum(axis=1, dtype=np.int64)


def block_keys(hashes: np.ndarray, first: np.ndarray, blocks: int) -> np.ndarray:
    """(lines, blocks): hashes of the blocks of lines, given their words' hashes and where lines begin.

    A cut lies before the word with the least hash within reach of its even place, so that it stays where it
    is when words elsewhere are changed, added or left out. Up to ``blocks - 1`` such changes that move no
    cut leave a block whole, by the pigeonhole principle. Each line has two words for each block at least.
    """
    counts = np.diff(np.append(first, len(hashes)))
    at = np.arange(len(hashes), dtype=np.int64) - np.repeat(first, counts)
    ranked = np.append(hashes >> np.uint64(24) << np.uint64(24) | at.astype(np.uint64), np.uint64(0))
    cuts = np.zeros((len(first), blocks + 1), np.int64)
    even = np.arange(1, blocks)[None, :]
    low = np.ceil((even - _REACH) * counts[:, None] / blocks).astype(np.int64)
    high = np.minimum(counts[:, None] - 1, np.floor((even + _REACH) * counts[:, None] / blocks).astype(np.int64))
    windows = np.stack([first[:, None] + low, first[:, None] + high + 1], axis=-1).reshape(-1)
    cuts[:, 1:-1] = (np.minimum.reduceat(ranked, windows)[::2] & np.uint64((1 << 24) - 1)).astype(np.int64).reshape(len(first), blocks - 1)
    cuts[:, -1] = counts
    cuts += first[:, None]
    forward, backward = bytehash._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * forward[: len(hashes)], out=sums[1:])
    own = mix((sums[cuts[:, 1:]] - sums[cuts[:, :-1]]) * backward[cuts[:, :-1]])
    return mix(own + (np.arange(blocks) + 64 * blocks).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _character_hashes(line: str) -> np.ndarray:
    """A hash of each character and the two after it."""
    codes = np.append(np.frombuffer(line.encode("utf-32-le"), np.uint32), np.zeros(2, np.uint32)).astype(np.uint64)
    return mix(mix(codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)))


def _segments(size: int, count: int) -> list[tuple[int, int]]:
    """(start, end) of ``count`` parts of nearly equal size."""
    edges = [size * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:], strict=False))


def segment_keys(line: str, least: float = SIMILARITY) -> set[int]:
    """Keys of which two short lines that are similar share one.

    With up to d edits one of d + 1 segments of the shorter line is whole in the longer one. Its place there
    differs by the edits before it and after it at most, and those are d together (Li et al., "Pass-Join", 2011).
    """
    size, share, keys = len(line), 1 - least, set()

    def allowed(length: int) -> int:
        return int(share * length + 1e-9)

    def key(edits: int, length: int, part: int, text: str) -> int:
        return xxhash.xxh64_intdigest(f"{edits} {length} {part} {text}", 7)

    longest = int(size / least + 1e-9)
    for edits in {allowed(n) for n in range(size, longest + 1)}:
        keys.update(key(edits, size, k, line[s:e]) for k, (s, e) in enumerate(_segments(size, edits + 1)))
    edits = allowed(size)
    for length in range(size - edits, size + 1):
        more = size - length
        for k, (s, e) in enumerate(_segments(length, edits + 1)):
            low = max(0, s - k, s + more - (edits - k))
            high = min(size - (e - s), s + k, s + more + (edits - k))
            keys.update(key(edits, length, k, line[p : p + e - s]) for p in range(low, high + 1))
    return keys


def line_keys(plain: list[str], hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of all keys of normalised lines, in the order of the lines."""
    sizes = np.array([len(x) for x in plain])
    counts = np.diff(np.append(first, len(hashes)))
    owner, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero((sizes < SHORT) & (sizes * (1 - SIMILARITY) + 1e-9 >= 0.9)):
        own = np.array(sorted(segment_keys(plain[k])), np.uint64)
        owner.append(np.full(len(own), k))
        keys.append(own.view(np.int64))
    # A line and one up to a ninth longer share a number of blocks: the longer one's.
    edges = np.array([most for most, _ in _BLOCKS])
    own, longer = np.searchsorted(edges, sizes, side="right"), np.searchsorted(edges, np.floor(sizes / SIMILARITY), side="right")
    for k, (_, blocks) in enumerate(_BLOCKS):
        some = np.flatnonzero((sizes >= SHORT * SIMILARITY) & ((own == k) | (longer == k)))
        by_words = some[counts[some] >= _WORDS_A_BLOCK * blocks]
        if len(by_words):
            begins = np.append(0, np.cumsum(counts[by_words])[:-1])
            at = np.arange(counts[by_words].sum()) + np.repeat(first[by_words] - begins, counts[by_words])
            owner.append(np.repeat(by_words, blocks))
            keys.append(block_keys(hashes[at], begins, blocks).ravel())
        for j in some[counts[some] < 1.25 * _WORDS_A_BLOCK * blocks]:
            owner.append(np.full(blocks, j))
            keys.append(block_keys(_character_hashes(plain[j]), np.zeros(1, np.int64), blocks).ravel() ^ 0x5DEECE66D)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order]


def banded_distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance if it is ``most`` or less, else a larger number; bit-parallel over the diagonals in reach (Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    ahead = len(a) - len(b)
    if ahead > most:
        return most + 1
    where: dict[str, int] = {}
    for k, char in enumerate(a):
        where.setdefault(char, []).append(k)
    matches = {}
    for char, places in where.items():
        held = bytearray(len(a) // 8 + 1)
        for k in places:
            held[k >> 3] |= 1 << (k & 7)
        matches[char] = int.from_bytes(held, "little")
    full = (1 << (2 * most + 1)) - 1
    up, down, distance, last = full ^ ((1 << most) - 1), 0, ahead, most + ahead
    for column, char in enumerate(b):
        shift = column - most
        match = matches.get(char, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full ^ (zero | up))
        left = zero & up
        distance += not zero >> last & 1  # the value on the diagonal that ends in the result never falls
        if distance > most:
            return most + 1
        up = left | (full ^ (zero >> 1 | right))
        down = zero >> 1 & right
    return distance


def edit_distance(a: str, b: str, enough: int | None = None) -> int:
    """Levenshtein distance, bit-parallel (Myers 1999, Hyyro 2003), after what both ends share is cut off.

    With ``enough`` any number beyond it may stand for a larger distance: neighbours in a column of distances
    differ by one at most, so that no path ends below what its last diagonal has reached.
    """
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if enough is not None and min(len(a), len(b)) > BAND:
        within = 32
        while within < enough and (found := banded_distance(a, b, within)) > within:
            within *= 4
        return found if within < enough else banded_distance(a, b, enough)
    where: dict[str, int] = {}
    for k, char in enumerate(a):
        where[char] = where.get(char, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance, ahead = full, 0, len(a), len(a) - len(b)
    for step, char in enumerate(b):
        if enough is not None and step & 7 == 0 and 0 < step + ahead:
            above = (1 << step + ahead) - 1
            reached = step + (up & above).bit_count() - (down & above).bit_count()
            if reached > enough:
                return reached
        match = where.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | ~(diagonal | up)
        left = up & diagonal
        distance += bool(right & top) - bool(left & top)
        right = right << 1 | 1
        left <<= 1
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal & full
    return distance


def pairs_apart(a: str, b: str) -> int:
    """By how many edits two lines differ at least: each changes two pairs of neighbours of either line at most."""
    counts = []
    for line in (a, b):
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        counts.append(np.bincount(codes[:-1] * np.uint32(37) + codes[1:] & 1023, minlength=1024))
    more = counts[0] - counts[1]
    return -(-int(max(more[more > 0].sum(), -more[more < 0].sum())) // 2)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most the share 1 - ``least`` of the longer line."""
    longer = max(len(a), len(b))
    allowed = int((1 - least) * longer + 1e-9)
    return abs(len(a) - len(b)) <= allowed and edit_distance(a, b, allowed) <= allowed


def all_similar(first: list[str], second: list[str], least: float) -> np.ndarray:
    """``similar`` of many pairs, of which those of up to LONG characters go together."""
    longer = np.array([max(len(a), len(b)) for a, b in zip(first, second, strict=True)], np.int64)
    found, allowed = np.zeros(len(longer), bool), np.floor((1 - least) * longer + 1e-9).astype(np.int64)
    short = np.flatnonzero(longer <= LONG)
    found[short] = within([first[k] for k in short], [second[k] for k in short], allowed[short])
    for k in np.flatnonzero(longer > LONG):
        found[k] = Line(first[k]).similar(Line(second[k]), least)
    return found


class Line:
    """A line and its words."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split(" ")

    def similar(self, other: Line, least: float) -> bool:
        """As ``similar``; an alignment of the words, which costs no less than the best, is tried first."""
        allowed = int((1 - least) * max(len(self.text), len(other.text)) + 1e-9)
        if abs(len(self.text) - len(other.text)) > allowed:
            return False
        if aligned_cost(self.words, other.words, allowed) <= allowed:
            return True
        return pairs_apart(self.text, other.text) <= allowed and edit_distance(self.text, other.text, allowed) <= allowed


def aligned_cost(a: list[str], b: list[str], enough: int, ahead: int = 3) -> int:
    """The cost of turning words ``a`` into ``b`` where equal words are met again within ``ahead`` words; beyond ``enough`` if not."""
    i = j = cost = 0
    while cost <= enough:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i == len(a) or j == len(b):
            rest = a[i:] or b[j:]
            return cost + sum(map(len, rest)) + len(rest)
        for p, q in _STEPS:
            if i + p < len(a) and j + q < len(b) and p <= ahead and q <= ahead and a[i + p] == b[j + q]:
                break
        else:
            p, q = len(a) - i, len(b) - j
            if max(p, q) > 2 * ahead:
                return enough + 1
        one, other = a[i : i + p], b[j : j + q]
        cost += edit_distance(" ".join(one), " ".join(other)) if p and q else sum(map(len, one + other)) + p + q
        i, j = i + p, j + q
    return cost


_STEPS = sorted(((p, q) for p in range(4) for q in range(4) if p + q), key=lambda x: (x[0] + x[1], abs(x[0] - x[1])))


def with_places(docs: DataFrame, place: tuple[Column, Column] | None, staging: Staging) -> DataFrame:
    """``docs`` as doc (a struct of its columns), text, and the place of each row: (file, idx).

    ``place`` gives two whole numbers that tell the rows apart in every scan; without it rows are numbered in a staged copy.
    """
    columns = [F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text")]
    if place:
        return docs.select(*columns, place[0].alias("file"), place[1].alias("idx"))
    return staging.write(docs.select(*columns, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("idx")), "docs")


def lines(placed: DataFrame) -> DataFrame:
    """(file, idx, line_no, line, check, fp, letters, size, keys): each line of ``placed(file, idx, text)`` that isn't blank, normalised.

    line and check are the halves of the line's MD5, fp is its SimHash, letters its letter_counts, size its characters and keys the
    hashes of its blocks or segments.
    """

    def made(held: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        files, rows, numbers, plain = zip(*held, strict=True)
        hashes, first = word_hashes("\n".join(plain).encode())
        owner, keys = line_keys(list(plain), hashes, first)
        ends = np.searchsorted(owner, np.arange(len(plain) + 1)).astype(np.int32)
        digests = np.frombuffer(b"".join(hashlib.md5(x.encode()).digest() for x in plain), np.int64).reshape(-1, 2)
        columns = [pa.array(files, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
        columns += [pa.array(fingerprints(hashes, first)), pa.array(letter_counts(list(plain))), pa.array([len(x) for x in plain], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "idx", "line_no", "line", "check", "fp", "letters", "size", "keys"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for file, idx, text in zip(*(batch[c].to_pylist() for c in ("file", "idx", "text")), strict=True):
                for number, line in enumerate((text or "").split("\n")):
                    plain = normalise(line)
                    if plain:
                        held.append((file, idx, number, plain))
                        size += len(plain)
                        if size >= _CHARS:  # features of many lines are made at once
                            yield made(held)
                            held, size = [], 0
            if held:
                yield made(held)

    return placed.select("file", "idx", "text").mapInArrow(split, "file long, idx long, line_no int, line long, check long, fp long, letters long, size int, keys array<long>")


def _near(a: str, b: str, least: float) -> Column:
    """Whether fingerprints, letters and sizes, of columns named by a prefix, let two lines be similar."""
    fp_a, letters_a, size_a = (F.col(a + c) for c in ("fp", "letters", "size"))
    fp_b, letters_b, size_b = (F.col(b + c) for c in ("fp", "letters", "size"))
    longer, gap = F.greatest(size_a, size_b), F.abs(size_a - size_b)
    most, allowed = F.when(longer < NEAR_CHARS, FEW_WORDS_NEAR).otherwise(NEAR), F.floor((1 - least) * longer + 1e-9)
    kinds = [F.shiftright(letters_a, k).bitwiseAND(15) - F.shiftright(letters_b, k).bitwiseAND(15) for k in range(0, 64, 4)]
    apart = sum((F.least(F.abs(x), F.lit(16) - F.abs(x)) for x in kinds), F.lit(0))
    return (F.bit_count(fp_a.bitwiseXOR(fp_b)) <= most) & (gap <= allowed) & (apart <= 2 * allowed - gap)


_MEMBER = ("key", "piece", "side", "line", "component", "size", "fp", "letters")
_MEMBER_TYPES = "key long, piece int, side int, line long, component long, size int, fp long, letters long"


def _near_places(rows: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of rows that are near and in different components, of whole pieces of buckets in order.

    side tells what a member is compared with: 0 with every other of its piece, 1 only with those of side 2.
    """
    key, piece, side, group = rows["key"], rows["piece"], rows["side"], rows["component"]
    size, fp, letters = rows["size"], rows["fp"].view(np.uint64), rows["letters"].view(np.uint64)
    starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1)
    ends = np.append(starts[1:], len(key))
    number = np.repeat(np.arange(len(starts)), ends - starts)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        longer, gap = np.maximum(size[i], size[j]), np.abs(size[i] - size[j])
        allowed = np.floor((1 - least) * longer + 1e-9)
        good = (gap <= allowed) & (np.bitwise_count(fp[i] ^ fp[j]) <= np.where(longer < NEAR_CHARS, FEW_WORDS_NEAR, NEAR))
        i, j, most = i[good], j[good], (2 * allowed - gap)[good]
        near = letters_apart(letters[i], letters[j]) <= most
        left.append(i[near])
        right.append(j[near])

    # Members of small pieces meet those so many rows behind them, in all pieces at once.
    small = np.flatnonzero(((ends - starts <= SMALL) & (side[starts] == 0))[number])
    for ahead in range(1, SMALL):
        small = small[small + ahead < len(key)]
        small = small[number[small] == number[small + ahead]]
        if not len(small):
            break
        met = small[group[small] != group[small + ahead]]
        add(met, met + ahead)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s <= SMALL and side[s] == 0:
            continue
        first, second = s + np.flatnonzero(side[s:e] != 2), s + np.flatnonzero(side[s:e] != 1)
        for start in range(0, len(first), 256):
            own = first[start : start + 256]
            few = (side[own, None] == 1) | (own[:, None] < second)
            i, j = np.nonzero(few & (group[own, None] != group[second]) & (np.bitwise_count(fp[own, None] ^ fp[second]) <= FEW_WORDS_NEAR))
            add(own[i], second[j])
    return np.concatenate(left), np.concatenate(right)


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """Rows sorted by bucket and piece, as tables that end where a piece does, with the columns of members."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key, piece = held["key"].to_numpy(), held["piece"].to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1
        if len(new):
            whole = held.slice(0, new[-1])
            yield whole, {c: whole[c].to_numpy() for c in _MEMBER}
            held = held.slice(new[-1])
    if held is not None and len(held) > 1:
        yield held, {c: held[c].to_numpy() for c in _MEMBER}


def _near_pairs(least: float):
    """(a, b): near pairs themselves, to see what the members of buckets are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _whole_pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["line"][k]) for k in _near_places(rows, least)], names=["a", "b"])

    return run


def _partnered(least: float):
    """The rows that are near another one of their bucket and piece in a different component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in _whole_pieces(batches):
            some = np.unique(np.concatenate(_near_places(rows, least)))
            if len(some):
                yield from table.select(list(_MEMBER)).take(pa.array(some)).combine_chunks().to_batches()

    return run


def _first_shared(keys: list[np.ndarray], key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows share no key less than their bucket's."""
    less = [x[x < k] for x, k in zip(keys, key, strict=True)]
    width = max(map(len, less))
    # Rows are filled up with two numbers that neither row of a pair has else.
    one, other = (np.repeat(x[:, None], width, axis=1) for x in (key, key + 1))
    for k, x in enumerate(less):
        one[k, : len(x)] = other[k, : len(x)] = x
    out, step = np.ones(len(i), bool), max(1, (1 << 22) // max(1, width) ** 2)
    for start in range(0, len(i), step):
        part = slice(start, start + step)
        out[part] = ~(one[i[part], :, None] == other[j[part], None, :]).any(axis=(1, 2))
    return out


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least member of each one's group, when ``a`` and ``b`` are linked as well."""
    while True:
        least, after = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _linked(least: float):
    """(a, b, sure): links of rows with plain and keys, of the pairs whose first common key is the bucket's; not sure if a line is long.

    Sure links are one for each member of a group within the rows at hand but its least one.
    """

    def frame(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), sure))], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in _whole_pieces(batches):
            i, j = _near_places(rows, least)
            if not len(i):
                continue
            first = _first_shared([np.array(x, np.int64) for x in table["keys"].to_pylist()], rows["key"], i, j)
            i, j, plain, size = i[first], j[first], table["plain"].to_pylist(), rows["size"]
            line, at = np.unique(rows["line"], return_inverse=True)
            long = np.maximum(size[i], size[j]) > LONG
            a, b = rows["line"][i[long]], rows["line"][j[long]]
            yield frame(np.minimum(a, b), np.maximum(a, b), False)
            order = np.random.default_rng(0).permutation(np.flatnonzero(~long))
            i, j, root = i[order], j[order], np.arange(len(line))
            while len(i):
                a, b = i[:TURN], j[:TURN]
                good = all_similar([plain[k] for k in a], [plain[k] for k in b], least)
                root = _roots(root, at[a[good]], at[b[good]])
                i, j = i[TURN:], j[TURN:]
                apart = root[at[i]] != root[at[j]]
                i, j = i[apart], j[apart]
            led = np.flatnonzero(root != np.arange(len(root)))
            yield frame(line[root[led]], line[led], True)

    return run


def _with_keys(may_meet: IdFilter):
    """A row for each of those keys of a line that ``may_meet`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["keys"]
            keys = lists.flatten().to_numpy()
            held = may_meet.held(keys)
            owner = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[held])
            columns = [batch[c].take(owner) for c in ("line", "fp", "letters", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[held])], names=["line", "fp", "letters", "size", "key"])

    return run


def _several(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` of those buckets whose lines lie in several components of ``edges``, with their component and the bucket's size."""
    grouped = connected_components(edges, Staging(members.sparkSession, "line-components"))
    named = members.join(grouped, members["line"] == grouped["node"], "left").select("key", "line", "fp", "letters", "size", F.coalesce("root", "line").alias("component"))
    apart = named.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count("*").alias("held")).where("one < other")
    return named.join(apart.select("key", "held"), "key")


def _pieces(several: DataFrame) -> DataFrame:
    """(key, line, fp, letters, size, component, piece, side): what is compared in each bucket.

    In a bucket of over CHUNK lines those outside its largest component, a chunk at a time, with every chunk of the bucket.
    """
    own = ["key", "line", "fp", "letters", "size", "component"]
    small = several.where(F.col("held") <= CHUNK).select(*own, F.lit(0).alias("piece"), F.lit(0).alias("side"))
    large = several.where(F.col("held") > CHUNK)
    if large.isEmpty():
        return small
    counts = large.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"))
    told = large.join(largest, "key").withColumns({"row_chunks": F.ceil((F.col("held") - F.col("most")) / CHUNK), "all_chunks": F.ceil(F.col("held") / CHUNK)})
    mixed, zero = F.xxhash64("line", F.lit("chunk")), F.lit(0).cast("long")
    piece = (F.col("row") * F.col("all_chunks") + F.col("column")).cast("int").alias("piece")
    rest = told.where("component != largest").select(*own, "all_chunks", F.pmod(mixed, "row_chunks").alias("row"), F.explode(F.sequence(zero, F.col("all_chunks") - 1)).alias("column"))
    every = told.select(*own, "all_chunks", F.pmod(mixed, "all_chunks").alias("column"), F.explode(F.sequence(zero, F.col("row_chunks") - 1)).alias("row"))
    return small.unionByName(rest.select(*own, piece, F.lit(1).alias("side"))).unionByName(every.select(*own, piece, F.lit(2).alias("side")))


def _few(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` as they are joined to texts: up to BROADCAST_ROWS are sent to where the texts are."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def _texts(placed: DataFrame, distinct: DataFrame, lines: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(line, plain) for each of the distinct ``lines``, read from the row where it occurs first."""
    wanted = lines.join(distinct.groupBy("line").agg(F.min("first").alias("first")), "line")
    by_row = staging.write(
        wanted.groupBy(F.col("first.file").alias("w_file"), F.col("first.idx").alias("w_idx")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "line")).alias("wanted")), f"wanted-{name}"
    )
    key, count = F.struct("file", "idx"), by_row.count()
    own = placed.select("file", "idx", "text").where(IdFilter(by_row.select(F.struct(F.col("w_file").alias("file"), F.col("w_idx").alias("idx"))), count).may_have(key))
    met = own.join(_few(by_row, count), (F.col("file") == F.col("w_file")) & (F.col("idx") == F.col("w_idx"))).select("text", "wanted")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, some in zip(batch["text"], batch["wanted"], strict=True):
                parts = text.split("\n")
                out += [(x["line"], normalise(parts[x["line_no"]])) for x in some]
            yield pd.DataFrame(out, columns=["line", "plain"])

    return staging.write(met.mapInPandas(pick, "line long, plain string"), f"texts-{name}")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("line")).unionAll(pairs.select("b")).distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, staging: Staging, name: str, least: float) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose edit similarity is ``least`` or more, as a staged table."""

    @F.pandas_udf("boolean")
    def alike(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(all_similar(first.tolist(), second.tolist(), least))

    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("plain").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("plain").alias("y")), "b")
    return staging.write(both.where(alike("x", "y")).select("a", "b"), f"similar-{name}")


def line_groups(placed: DataFrame, staging: Staging, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The lines of ``placed`` as ``lines`` gives them, and (line, check, first, count, root) of each distinct one.

    root tells the connected group of lines whose edit similarity is ``least`` or more, that share a key and whose
    fingerprints differ in few bits (see NEAR); counts of letters tell apart only what can't be similar; first is the (file, idx, line_no) it occurs at first. Each
    line is compared with one hub, the least line of its largest bucket. While large buckets lie in
    several components, turns with other hubs follow; then near lines of different components in each bucket are compared.
    """
    found = staging.write(lines(placed), "lines")
    place = F.struct("file", "idx", "line_no")
    distinct = staging.write(
        found.groupBy("line", "check").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min(place).alias("first"), F.count("*").alias("count")), "distinct"
    )
    keyed = found.select("line", "fp", "letters", "size", F.explode("keys").alias("key"))
    buckets = staging.write(
        keyed.groupBy("key").agg(F.min("line").alias("one"), F.max("line").alias("other")).where("one < other").select("key"), "buckets"
    )
    may_meet = IdFilter(buckets, buckets.count(), hashed=True)
    some = found.select("line", "fp", "letters", "size", "keys").mapInArrow(_with_keys(may_meet), "line long, fp long, letters long, size int, key long")
    met = some.join(buckets, "key", "left_semi").groupBy("key", "line").agg(F.min("fp").alias("fp"), F.min("letters").alias("letters"), F.min("size").alias("size"))
    with staging.batches(8192):
        members = staging.write(met, "members")
    hubs = members.groupBy("key").agg(F.min(F.struct("line", "fp", "letters", "size")).alias("hub"), F.count("*").alias("held"))

    def stars(rows: DataFrame) -> DataFrame:
        """(a, b) for each line and the hub of the largest bucket where the two are near."""
        near = rows.where((F.col("line") != F.col("hub.line")) & _near("", "hub.", least))
        largest = near.groupBy("line").agg(F.max(F.struct("held", "key", F.col("hub.line").alias("hub"))).alias("largest"))
        return largest.select(F.col("largest.hub").alias("a"), F.col("line").alias("b"))

    first = staging.write(stars(members.join(hubs, "key")), "stars-0")
    edges = similar_pairs(first, _texts(placed, distinct, _ends(first), staging, "0"), staging, "0", least)
    several = staging.write(_several(members, edges), "several-0")
    for turn in range(1, HUBS):
        large = several.where(F.col("held") > SMALL)
        if large.isEmpty():
            break
        other = large.groupBy("key").agg(F.min_by(F.struct("line", "fp", "letters", "size", "component"), F.xxhash64("line", F.lit(turn))).alias("hub"))
        more = staging.write(stars(large.join(other, "key").where("component != hub.component")), f"stars-{turn}")
        edges = edges.unionByName(similar_pairs(more, _texts(placed, distinct, _ends(more), staging, str(turn)), staging, str(turn), least))
        several = staging.write(_several(members, edges), f"several-{turn}")
    rows = _pieces(several).repartition("key", "piece").sortWithinPartitions("key", "piece")
    with staging.batches(8192):
        active = staging.write(rows.select(*_MEMBER).mapInArrow(_partnered(least), _MEMBER_TYPES), "active")
    # Each pair is compared in the first bucket it shares, so lines go with all buckets where they have a partner.
    texts = _texts(placed, distinct, active.select("line").distinct(), staging, "rest")
    plain = F.when(F.length("plain") <= LONG, F.col("plain")).alias("plain")
    told = active.groupBy("line").agg(F.array_sort(F.collect_set("key")).alias("keys")).join(texts.select("line", plain), "line")
    rows = active.join(told, "line").select(*_MEMBER, "keys", "plain").repartition("key", "piece").sortWithinPartitions("key", "piece")
    links = staging.write(rows.mapInArrow(_linked(least), "a long, b long, sure boolean"), "links")
    long = similar_pairs(links.where("not sure").select("a", "b").distinct(), texts, staging, "rest", least)
    edges = edges.unionByName(links.where("sure").select("a", "b")).unionByName(long)
    grouped = connected_components(edges, staging)
    return found, distinct.join(grouped.withColumnRenamed("node", "line"), "line", "left").select("line", "check", "first", "count", F.coalesce("root", "line").alias("root"))


def dedup_lines(docs: DataFrame, least: float = SIMILARITY, place: tuple[Column, Column] | None = None) -> DataFrame:
    """``docs`` with text without repeated lines, and lines and dropped, the numbers of both.

    Of each connected group of fuzzy lines one occurrence stays: the first by the place of its row (file and row within it) and
    its line number, so ids don't matter, and may be null or repeat. Blank lines always stay. A null text
    stays null and has no line; an empty table gives no row. Lines end at a line feed. For ``place`` see ``with_places``.
    """
    staging = Staging(docs.sparkSession, "lines")
    placed = with_places(docs, place, staging)
    found, named = line_groups(placed, staging, least)
    named = staging.write(named, "named")
    groups = named.groupBy("root").agg(F.min("first").alias("stays"), F.sum("count").alias("size")).where("size > 1")
    losing = named.join(groups, "root").select("line", "check", "stays")
    gone = found.select("file", "idx", "line_no", "line", "check").join(losing, ["line", "check"]).where(F.struct("file", "idx", "line_no") != F.col("stays"))
    by_row = staging.write(gone.groupBy(F.col("file").alias("l_file"), F.col("idx").alias("l_idx")).agg(F.collect_list("line_no").alias("lost")), "lost")
    rows = by_row.count()
    touched = IdFilter(by_row.select(F.struct(F.col("l_file").alias("file"), F.col("l_idx").alias("idx"))), rows)
    key, whole = F.struct("file", "idx"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    count = F.coalesce(whole, F.lit(0)).cast("int")

    @F.pandas_udf("string")
    def without(texts: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, lost, strict=True):
            gone = set(some)
            out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone))
        return pd.Series(out, dtype="object")

    fields = lambda text, dropped: [*(F.col(f"doc.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns), count.alias("lines"), dropped.cast("int").alias("dropped")]
    clean = placed.where(~touched.may_have(key)).select(*fields(F.col("text"), F.lit(0)))
    met = placed.where(touched.may_have(key)).join(_few(by_row, rows), (F.col("file") == F.col("l_file")) & (F.col("idx") == F.col("l_idx")), "left")
    same = met.where("lost is null").select(*fields(F.col("text"), F.lit(0)))
    changed = met.where("lost is not null").select(*fields(without("text", "lost"), F.size("lost")))
    return clean.unionByName(same).unionByName(changed)
