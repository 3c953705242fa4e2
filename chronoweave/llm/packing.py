"""Packing: the concatenated tokens of all documents, cut into sequences of equal length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.bytehash import segments
from chronoweave.llm.staging import Staging
from chronoweave.llm.wordcache import CHUNK_CHARS, WordCache, by_chunk

LENGTH = 4096
END = 2
#: Of words and of pieces of words, a worker holds about twice as many at most.
REMEMBERED = 200_000
_TOGETHER = 20_000
#: Words of characters that composition leaves alone and that are lower-cased one by one in the same way everywhere.
_PLAIN = "^[!-~\u00a1-\u012f\u0131-\u024f]+$"
_workers: dict[tuple[str, bool], "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, so that each word has ids of its own.

    The distinct words of some texts are told apart by Arrow. Where the tokenizer lower-cases words and
    splits them into runs of letters, single digits and runs of other marks, plain words are split alike
    here, and the ids of their pieces are remembered: ``Was,`` and ``was.`` share one. Words with
    characters beyond ``_PLAIN``, or with the string of an added token, are given to the library as
    they are, and are remembered whole.
    """

    def __init__(self, path: str, special: bool = True, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rule = _split_rule(json.loads(self.tokenizer.to_str()))
        if self.rule is not None:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            suffix = self.tokenizer.model.end_of_word_suffix
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.words, self.pieces = WordCache(self._whole, remembered), WordCache(self._together, remembered)

    def _whole(self, words: list[str]) -> list[bytes]:
        """The ids of each word as the library gives them."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Pieces are encoded together; the last token of each ends a word, no other does."""
        out: list[bytes] = []
        for start in range(0, len(pieces), _TOGETHER):
            part = pieces[start : start + _TOGETHER]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):
                out += [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self._whole(part)
        return out

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, how many each has, and the order of the words there."""
        by_pieces = np.zeros(len(words), bool)
        if self.rule is not None:
            by_pieces = _flags(pc.ascii_is_printable(words))
            other = np.flatnonzero(~by_pieces)
            by_pieces[other] = _flags(pc.match_substring_regex(words.take(other), _PLAIN))
            for added in self.added:
                by_pieces &= ~_flags(pc.match_substring(words, added))
        sizes, order, pools = np.zeros(len(words), np.int64), [], []
        if by_pieces.any():
            at = np.flatnonzero(by_pieces)
            low = pc.utf8_lower(words.take(at))
            letters = _flags(pc.utf8_is_alpha(low))  # one piece each
            at = np.concatenate((at[letters], at[~letters]))
            split = pc.ascii_split_whitespace(pc.replace_substring_regex(low.filter(~letters), self.rule, "\\1 "))
            named = pa.concat_arrays([low.filter(letters), split.flatten()]).dictionary_encode()
            ids, n = _expanded(self.pieces.of(_strings(named.dictionary)), named.indices.to_numpy())
            pools.append(ids)
            bounds = np.append(np.arange(letters.sum()), letters.sum() + split.offsets.to_numpy() - split.offsets[0].as_py())
            sizes[at] = np.diff(np.append(0, np.cumsum(n))[bounds])
            order.append(at)
        if not by_pieces.all():
            at = np.flatnonzero(~by_pieces)
            values = self.words.of(_strings(words.take(at)))
            pools.append(np.frombuffer(b"".join(values), np.uint32))
            sizes[at] = [len(x) // 4 for x in values]
            order.append(at)
        return np.concatenate(pools or [np.zeros(0, np.uint32)]), sizes, np.concatenate(order or [np.zeros(0, np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has. Long texts are cut at blanks meanwhile."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            own = [text] if len(text) <= CHUNK_CHARS else [x.decode() for x in segments(text.encode(), CHUNK_CHARS)]
            parts += own
            owner += [k] * len(own)
        found, sizes, start = [], [], 0
        while start < len(parts):
            stop, held = start, 0
            while stop < len(parts) and (stop == start or held + len(parts[stop]) <= 2 * CHUNK_CHARS):
                held += len(parts[stop])
                stop += 1
            ids, counts = self._encode(parts[start:stop])
            found.append(ids)
            sizes.append(counts)
            start = stop
        total = np.bincount(owner, np.concatenate(sizes), len(texts)).astype(np.int64) if parts else np.zeros(0, np.int64)
        return np.concatenate(found or [np.zeros(0, np.uint32)]), total

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        named = words.flatten().dictionary_encode()
        number = named.indices.to_numpy()
        pool, sizes, order = self._of_words(named.dictionary)
        first = np.zeros(len(sizes), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        n = sizes[number]
        ends = np.append(0, np.cumsum(n))
        ids = pool[np.arange(ends[-1]) + np.repeat(first[number] - ends[:-1], n)]
        return ids, np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()])


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _expanded(values: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the numbered values one after the other, and how many each has."""
    sizes = np.array([len(x) // 4 for x in values], np.int64)
    pool, first, n = np.frombuffer(b"".join(values), np.uint32), np.cumsum(sizes) - sizes, sizes[number]
    ends = np.cumsum(n)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[number] - (ends - n), n)], n


def _split_rule(config: dict) -> str | None:
    """The pattern of the pieces of plain words, as a group; none for a tokenizer of other rules."""
    normalizers = [x.get("type") for x in (config["normalizer"] or {}).get("normalizers", [])]
    splitters = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    if normalizers != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splitters] != ["Split", "ByteLevel"]:
        return None
    if splitters[0]["behavior"] != "Removed" or not splitters[0]["invert"] or not config["model"].get("end_of_word_suffix"):
        return None
    return f"({splitters[0]['pattern']['Regex']})"


def worker_encoder(path: str, special: bool = True) -> WordEncoder:
    """The encoder of this worker process; a worker has one for each file and rule of added tokens."""
    if (path, special) not in _workers:
        _workers[path, special] = WordEncoder(path, special)
    return _workers[path, special]


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, special: bool = True) -> DataFrame:
    """(part, start, n_tokens, doc_id, ids): ids of each text and then ``end``, with the row's offset in its partition.

    A null text is empty. ids are little-endian, two bytes each while they fit, which ``wide`` tells apart.
    The strings of added tokens in a text become those tokens, as in a call of the library, unless
    ``special`` is false; then they are ordinary text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, start long, n_tokens long, doc_id {kind}, wide boolean, ids binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, start = worker_encoder(tokenizer, special), 0
        for batch in by_chunk(batches):
            ids, counts = encoder.encode([text or "" for text in batch["text"]])
            ends = np.cumsum(counts)
            ids, sizes = np.insert(ids, ends, np.uint32(end)), counts + 1
            wide = bool(ids.max() > 65535)
            data, width = (ids.tobytes(), 4) if wide else (ids.astype(np.uint16).tobytes(), 2)
            bounds = np.append(0, np.cumsum(sizes))
            yield pd.DataFrame({
                "part": batch["part"].to_numpy(np.int32), "start": start + bounds[:-1], "n_tokens": sizes, "doc_id": batch["doc_id"].to_list(),
                "wide": wide, "ids": [data[a:b] for a, b in zip((bounds[:-1] * width).tolist(), (bounds[1:] * width).tolist(), strict=True)],
            })
            start += int(bounds[-1])

    return docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInPandas(encode, schema)


def cut(ids: np.ndarray, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, n, sequence, offset) of the pieces of a document whose first id has the global number ``at``."""
    start = 0
    while start < len(ids):
        sequence, offset = divmod(at + start, length)
        n = min(length - offset, len(ids) - start)
        yield start, n, sequence, offset
        start += n


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, special: bool = True) -> DataFrame:
    """The pieces of all documents of ``docs(doc_id, text)``, concatenated and cut at multiples of ``length``.

    Returns doc_id, start (the document's ids before the piece), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens (ids of the document, the end id included),
    sequence_id and offset. Only the last sequence can be shorter than ``length``. Each id is in exactly
    one piece: a document that crosses a boundary has a piece on either side. A null or empty text is
    the end id alone; an empty table has no piece; repeated rows are documents of their own. The strings
    of added tokens in a text are encoded as ``tokenized`` says.

    The first pass tokenizes and numbers the ids within each partition; the partitions' totals,
    summed up to each partition, give their offsets in the second, which cuts.
    """
    staging = Staging(docs.sparkSession, "packing")
    rows = staging.write(tokenized(docs, tokenizer, end, special), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staging.write(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")), "offsets")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, at, wide, ids in zip(batch["doc_id"], batch["at"], batch["wide"], batch["ids"], strict=True):
                values = np.frombuffer(ids, np.uint32 if wide else np.uint16).astype(np.uint32)
                for start, n, sequence, offset in cut(values, int(at), length):
                    out.append((doc_id, start, n, zlib.crc32(values[start : start + n].tobytes()), len(values), sequence, offset))
            yield pd.DataFrame(out, columns=columns)

    placed = rows.join(offsets, "part").select("doc_id", (F.col("before") + F.col("start")).alias("at"), "wide", "ids")
    return placed.mapInPandas(
        pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
