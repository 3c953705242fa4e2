"""Alignment of two tokenizers' tokens by lockstep merging of their byte ranges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging
from chronoweave.llm.wordcache import WordCache

CHUNK_BYTES = 4 << 20
#: A lane has about so many tokens of A; a longer text takes several lanes, which begin at words.
LANE = 512
REMEMBERED = 200_000
#: Only words of at most so many characters are remembered.
WORD_CHARS = 64
#: Bound of the id pairs that are broadcast at once.
BLOCK_PAIRS = 2_000_000
#: Bound of the id pairs that a task holds before it passes their sums on.
HELD_PAIRS = 2_000_000

_LENGTH, _ID, _FIRST, _OTHER = 14, 16, np.uint32(1 << 30), np.uint32(1 << 31)
_ODD_BLANKS = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """``text`` cut at each single blank between other characters, where neither tokenizer can have a token across."""
    return _CUT.split(text) if _ODD_BLANKS.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Tokens of single words by both tokenizers, packed in 32 bits: whether of B, whether the word's first, id and byte length."""

    def __init__(self, a_path: str, b_path: str, pattern: str, remembered: int = REMEMBERED):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, special = model["model"]["vocab"], {x["content"] for x in model.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): n for t, n in vocabulary.items() if t not in special}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        made = [vocabulary["".join(x)] for x in pairs]
        if made != sorted(made):
            raise ValueError("the merges of the first tokenizer are not in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_sizes = np.zeros(max(vocabulary.values()) + 1, np.uint32)
        for token, number in ranks.items():
            self.a_sizes[number] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        count = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
            for k in range(count)
        ]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.uint32)
        if max(len(self.a_sizes), count) > 1 << _ID or max(self.a_sizes.max(), self.b_sizes.max()) >= 1 << _LENGTH:
            raise ValueError("a vocabulary has over 65,536 ids, or a token of over 16,383 bytes")
        self.cache = WordCache(self._make, remembered)

    def _make(self, words: list[str]) -> list[bytes]:
        """Tokens of A, then of B, of a blank and each word; none where B's bytes are others."""
        out = []
        for word, ids in zip(words, self.b.encode(words, num_threads=1), strict=True):
            if b"".join(map(self.b_bytes.__getitem__, ids)) != b" " + word.encode():
                out.append(b"")
                continue
            first, second = np.array(self.a.encode_ordinary(" " + word), np.uint32), np.array(ids, np.uint32)
            first = first << np.uint32(_LENGTH) | self.a_sizes[first]
            second = second << np.uint32(_LENGTH) | self.b_sizes[second] | _OTHER
            first[0] |= _FIRST
            second[0] |= _FIRST
            out.append(first.tobytes() + second.tobytes())
        return out

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The packed tokens of all texts in one array, and how many each has. A text with a word that B changes has none."""
        split = [words_of(text) if text else [] for text in texts]
        words = set().union(*split)
        short, long = [w for w in words if len(w) <= WORD_CHARS], [w for w in words if len(w) > WORD_CHARS]
        table = dict(zip(short, self.cache.of(short), strict=True)) | dict(zip(long, self._make(long), strict=True))
        parts = []
        for own in split:
            held = [table[w] for w in own]
            parts.append(b"" if b"" in held else b"".join(held))
        return np.frombuffer(b"".join(parts), np.uint32), np.array([len(x) // 4 for x in parts], np.int64)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray):
    """Merge the byte ranges of A's and B's tokens in all lanes at once.

    Lane k stands at tokens ``a[k]`` and ``b[k]`` and is finished when its pointer of A reaches ``stop[k]``,
    where B's tokens end too. Each step links the two tokens of every lane, moves on past the one that
    ends first, or past both (a cut), and leaves out the lanes that are finished. Returns the token
    numbers of the links, (of A, of B), and of the cuts.
    """
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        x, y = a_ends[a], b_ends[b]
        links_a.append(a)
        links_b.append(b)
        cut = x == y
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (x <= y), b + (y <= x)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return joined(links_a), joined(links_b), joined(cuts_a), joined(cuts_b)


_WIDTH = 6
_DIGITS = np.array([list(str(k).ljust(_WIDTH).encode()) for k in range(1 << _ID)], np.uint8)
_DIGIT_COUNT = np.array([len(str(k)) for k in range(1 << _ID)], np.int64)
_SHOWN = np.arange(_WIDTH) <= np.arange(_WIDTH)[:, None]


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> list[str]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``; ``a_last`` and ``b_last`` tell which tokens end a group."""
    a_ends, b_ends = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_at = np.arange(len(a_ids)) + np.append(0, b_ends)[a_group]
    b_at = np.arange(len(b_ids)) + a_ends[b_group]
    ids, after = np.zeros(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    after[a_at[a_last]], after[b_at[b_last]] = ord("|"), ord(";")
    digits, counts = _DIGITS[ids], _DIGIT_COUNT[ids]
    digits[np.arange(len(ids)), counts] = after
    flat = digits[_SHOWN[counts]].tobytes()
    ends = np.append(0, np.cumsum(counts + 1))[np.cumsum(a_counts + b_counts)]
    return [flat[start : max(start, end - 1)].decode() for start, end in zip(np.append(0, ends[:-1]), ends, strict=True)]


def align_texts(tokens: Tokens, texts: list[str | None]) -> dict[str, list | np.ndarray]:
    """n_a, n_b, n_groups, n_links, groups and the links' id pairs with their counts, for each text."""
    packed, sizes = tokens.of(texts)
    text = np.repeat(np.arange(len(texts)), sizes)
    other = packed >= _OTHER
    ids = (packed >> np.uint32(_LENGTH) & np.uint32((1 << _ID) - 1)).astype(np.int64)
    lengths, first = (packed & np.uint32((1 << _LENGTH) - 1)).astype(np.int64), packed & _FIRST > 0
    a_ids, b_ids, a_text, b_text = ids[~other], ids[other], text[~other], text[other]
    a_ends, b_ends = np.cumsum(lengths[~other]), np.cumsum(lengths[other])
    a_words, b_words = np.flatnonzero(first[~other]), np.flatnonzero(first[other])
    begins = np.append(True, (a_text[a_words][1:] != a_text[a_words][:-1]) | (a_words[1:] // LANE != a_words[:-1] // LANE))[: len(a_words)]
    a_from, b_from = a_words[begins], b_words[begins]
    link_a, link_b, cut_a, cut_b = lockstep(a_ends, b_ends, a_from, b_from, np.append(a_from[1:], len(a_ids))[: len(a_from)])
    a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_last[cut_a], b_last[cut_b] = True, True
    n = len(texts)
    n_a, n_b = np.bincount(a_text, minlength=n), np.bincount(b_text, minlength=n)
    width = len(tokens.b_sizes)
    keys, counts = np.unique(a_text[link_a] * (len(tokens.a_sizes) * width) + a_ids[link_a] * width + b_ids[link_b], return_counts=True)
    owner, keys = np.divmod(keys, len(tokens.a_sizes) * width)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(a_text[cut_a], minlength=n), "n_links": np.bincount(a_text[link_a], minlength=n),
        "groups": groups_text(a_ids, b_ids, a_last, b_last, n_a, n_b),
        "pairs": [keys[s:e].tobytes() for s, e in zip(bounds, bounds[1:], strict=False)],
        "counts": [counts[s:e].astype(np.int32).tobytes() for s, e in zip(bounds, bounds[1:], strict=False)],
    }


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about CHUNK_BYTES of text, or one text more."""
    start, size = 0, 0
    for k, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_pylist()):
        size += n
        if size >= CHUNK_BYTES:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_held: dict[tuple, Tokens] = {}


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """The alignment of each row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, counts.

    A (a byte-level BPE of the ``tokenizers`` library, given as its JSON file) encodes a blank and the
    text, B (a SentencePiece model, which adds a blank itself) the text, both without special tokens. groups has
    the groups between the byte offsets where tokens of both end, as ``a1,a2|b1;a3|b2,b3``; each pair of
    overlapping tokens is a link. pairs and counts hold the distinct id pairs of the links, as 64-bit
    ``a * (ids of B) + b`` in order, and how many links each has, in 32 bits. A null or empty text, or one that B changes,
    has zeros and empty values. Texts are cut into words that neither tokenizer joins, so that
    repeated words are encoded once and a long text is merged in several lanes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path, pattern)
        if key not in _held:
            _held[key] = Tokens(*key)
        for batch in batches:
            for piece in _pieces(batch):
                made = align_texts(_held[key], piece["text"].to_pylist())
                columns = [piece["doc_id"], *(pa.array(made[c], pa.int64()) for c in _COUNTS)]
                columns += [pa.array(made["groups"], pa.string()), pa.array(made["pairs"], pa.binary()), pa.array(made["counts"], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "groups", "pairs", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}, groups string, pairs binary, counts binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each id pair in a partition."""
    keys, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([keys, *(k for k, _ in waiting)])
        found, where = np.unique(every, return_inverse=True)
        return found, np.bincount(where, np.concatenate([sums, *(n for _, n in waiting)]), len(found)).astype(np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    for batch in batches:
        own = np.frombuffer(b"".join(batch["pairs"].to_pylist()), np.int64)
        waiting.append((own, np.frombuffer(b"".join(batch["counts"].to_pylist()), np.int32).astype(np.int64)))
        size += len(own)
        if size > HELD_PAIRS:
            keys, sums = merged()
            waiting, size = [], 0
            if len(keys) > HELD_PAIRS:
                yield row()
                keys, sums = keys[:0], sums[:0]
    keys, sums = merged()
    yield row()


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): the links of each id pair in all of ``aligned``, and whether no other pair of its B id has more.

    A B id has no more pairs than A has ids, which bounds what meets in a window.
    """
    totals = aligned.select("pairs", "counts").mapInArrow(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(b_ids))))
    return totals.select("pair", "n", (F.col("n") == most).alias("best"))


def corpus_scores(aligned: DataFrame, totals: DataFrame, staging: Staging) -> DataFrame:
    """``aligned``, which is staged with a column row, with n_best and count_sum; its pairs and counts go.

    n_best counts a row's links whose id pair is the most frequent of its B id, count_sum adds the counts of
    the id pairs of all its links. Id pairs are broadcast in blocks of about BLOCK_PAIRS, told by hash,
    a pass over the rows for each block.
    """
    blocks = max(1, -(-totals.count() // BLOCK_PAIRS))
    columns = [c for c in aligned.columns if c not in ("pairs", "counts")]
    parts = []
    for block in range(blocks):
        own = totals.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toPandas().sort_values("pair")
        shared = aligned.sparkSession.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("pair", "n", "best")))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, totals, best = shared.value
            for batch in batches:
                pairs, counts = batch["pairs"].to_pylist(), np.frombuffer(b"".join(batch["counts"].to_pylist()), np.int32).astype(np.int64)
                ends = np.cumsum([len(x) // 8 for x in pairs]) if pairs else np.zeros(0, np.int64)
                pairs = np.frombuffer(b"".join(pairs), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    here = counts * (known[at] == pairs)
                    of_best, weighed = np.append(0, np.cumsum(here * best[at])), np.append(0, np.cumsum(here * totals[at]))
                else:
                    of_best = weighed = np.zeros(len(pairs) + 1, np.int64)
                starts = np.append(0, ends)[:-1] if len(ends) else ends
                made = [pa.array(of_best[ends] - of_best[starts]), pa.array(weighed[ends] - weighed[starts])]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *made], names=[*columns, "n_best", "count_sum"])

        kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in columns)
        scored = aligned.mapInArrow(score, f"{kinds}, n_best long, count_sum long")
        parts.append(scored if blocks == 1 else staging.write(scored, f"scores-{block}"))
    if blocks == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    same = [F.first(c).alias(c) for c in columns if c != "row"]
    return whole.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null, empty and changed texts (see ``align``) have zeros and the digest '' ; ids may be null or repeat. An
    empty table gives no row. Links of id pairs are counted over all rows.
    """
    import sentencepiece

    staging = Staging(docs.sparkSession, "alignment")
    made = align(docs, a_path, b_path, pattern).withColumn("row", F.monotonically_increasing_id())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    aligned = staging.write(made.select("row", "doc_id", *_COUNTS, "pairs", "counts", digest), "aligned")
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    totals = staging.write(pair_counts(aligned, b_ids), "totals")
    return corpus_scores(aligned, totals, staging).select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
