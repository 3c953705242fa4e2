"""Byte-level BPE encoding and decoding with DuckDB queries in each partition."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging
from chronoweave.llm.wordcache import CHUNK_CHARS, REMEMBERED, WordCache, by_chunk

_WORDS_A_QUERY = 20_000
#: A query keeps the rows of all its turns: for a word up to the square of its bytes.
_ROWS_A_QUERY = 8_000_000
_IDS_A_QUERY = 1 << 19
_WORDS_AT_ONCE = 1 << 19
_workers: dict[tuple[str, str], "DuckBpe"] = {}

#: A state has a row for each token of each word that still changes: its place, its follower, and what
#: the two merge to. The leftmost pair of least rank of each word is contracted: its first row takes
#: the merged token, its second row goes, and the changed pairs meet the merge table again. Words that
#: still change after the given number of turns come back as open.
_ENCODE = """
WITH RECURSIVE state AS (
  SELECT 0 AS turn, b.word, b.pos, b.token, n.pos AS next_pos, n.token AS following, m.merged
  FROM bytes_of_words b
  LEFT JOIN bytes_of_words n ON n.word = b.word AND n.pos = b.pos + 1
  LEFT JOIN merges m ON m.pair = b.token::BIGINT << 32 | n.token
  UNION ALL
  SELECT s.turn, s.word, s.pos, s.token, s.next_pos, s.following, m.merged
  FROM (
    SELECT s.turn + 1 AS turn, s.word, s.pos,
           CASE WHEN s.pos = b.pos THEN b.merged ELSE s.token END AS token,
           CASE WHEN s.pos = b.pos THEN q.next_pos ELSE s.next_pos END AS next_pos,
           CASE WHEN s.pos = b.pos THEN q.following WHEN s.next_pos = b.pos THEN b.merged ELSE s.following END AS following
    FROM state s
    JOIN (
      SELECT word, least & 4294967295 AS pos, (least >> 32)::INTEGER AS merged, absorbed
      FROM (
        SELECT word, min(merged::BIGINT << 32 | pos) AS least, arg_min(next_pos, merged::BIGINT << 32 | pos) AS absorbed
        FROM state WHERE merged IS NOT NULL GROUP BY word
      )
    ) b ON b.word = s.word
    JOIN state q ON q.word = b.word AND q.pos = b.absorbed
    WHERE s.pos <> b.absorbed AND s.turn < $turns
  ) s
  LEFT JOIN merges m ON m.pair = s.token::BIGINT << 32 | s.following
)
SELECT word, list(token ORDER BY pos) AS ids, count(merged) > 0 AS open
FROM state JOIN (SELECT word, max(turn) AS turn FROM state GROUP BY word) USING (word, turn)
GROUP BY word
"""

_DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text
FROM ids_of_texts JOIN pieces USING (token)
GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pd.DataFrame:
    """(token, following, merged): each pair of tokens whose bytes together are a token."""
    rows = [
        (left, right, merged)
        for token, merged in ranks.items()
        for k in range(1, len(token))
        if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
    ]
    return pd.DataFrame(rows, columns=["token", "following", "merged"], dtype="int32")


class DuckBpe:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import duckdb
        import regex

        self.pattern, self.ranks = regex.compile(pattern), read_ranks(path)
        self.cache = WordCache(self._make, remembered)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        table_of_merges = merge_table(self.ranks)  # noqa: F841  DuckDB reads frames by their name
        self.db.execute("CREATE TABLE merges AS SELECT token::BIGINT << 32 | following AS pair, merged FROM table_of_merges")
        # A byte b is written as the character 256 + b, so that tokens that are no UTF-8 are strings as well.
        pieces = pd.DataFrame({"token": list(self.ranks.values()), "piece": ["".join(chr(256 + b) for b in t) for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE pieces AS SELECT token::INTEGER AS token, piece FROM pieces")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _make(self, words: list[str]) -> list[bytes]:
        """The ids of each word: its own token if it has one, else what the query contracts it to."""
        out, apart = [], []
        for word in words:
            data = word.encode()
            whole = self.ranks.get(data)
            if whole is None:
                apart.append((len(out), data))
            out.append(b"" if whole is None else np.array([whole], np.uint32).tobytes())
        start = 0
        while start < len(apart):
            stop, size = start, 0
            while stop < len(apart) and stop - start < _WORDS_A_QUERY and (stop == start or size + len(apart[stop][1]) ** 2 <= _ROWS_A_QUERY):
                size += len(apart[stop][1]) ** 2
                stop += 1
            for k, ids in self._contract([data for _, data in apart[start:stop]]):
                out[apart[start + k][0]] = np.array(ids, np.uint32).tobytes()
            start = stop
        return out

    def _contract(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(number, ids) of each word. Long words take several queries, so that none keeps too many rows."""
        names, lengths = np.arange(len(words), dtype=np.int32), np.array([len(data) for data in words], np.int64)
        tokens, done = self.single[np.frombuffer(b"".join(words), np.uint8)], []
        while len(names):
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            bytes_of_words = pd.DataFrame({  # noqa: F841
                "word": np.repeat(names, lengths),
                "pos": (np.arange(len(tokens)) - first).astype(np.int32),
                "token": tokens,
            })
            found = self.db.execute(_ENCODE, {"turns": max(1, _ROWS_A_QUERY // len(tokens))}).fetchall()
            done += [(word, ids) for word, ids, is_open in found if not is_open]
            rest = [(word, ids) for word, ids, is_open in found if is_open]
            names, lengths = np.array([word for word, _ in rest], np.int32), np.array([len(ids) for _, ids in rest], np.int64)
            tokens = np.array([token for _, ids in rest for token in ids], np.int32)
        return done

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, little-endian unsigned 32-bit. The words of a long text are looked up some at a time."""
        short = [k for k, text in enumerate(texts) if len(text) <= CHUNK_CHARS]
        out = [b""] * len(texts)
        for k, ids in zip(short, self.cache.values([self.pattern.findall(texts[k]) for k in short]), strict=True):
            out[k] = ids
        for k, text in enumerate(texts):
            if len(text) > CHUNK_CHARS:
                words, parts = (m.group() for m in self.pattern.finditer(text)), []
                while some := list(islice(words, _WORDS_AT_ONCE)):
                    parts += self.cache.values([some])
                out[k] = b"".join(parts)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids. A query has a bounded number of ids: long sequences take several, in order."""
        out: list[list[bytes]] = [[] for _ in ids]
        held, size = [], 0
        for number, own in enumerate(ids):
            for start in range(0, len(own), 4 * _IDS_A_QUERY):
                part = own[start : start + 4 * _IDS_A_QUERY]
                if size + len(part) > 4 * _IDS_A_QUERY:
                    self._decoded(held, out)
                    held, size = [], 0
                held.append((number, part))
                size += len(part)
        self._decoded(held, out)
        return [b"".join(parts) for parts in out]

    def _decoded(self, parts: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Append the bytes of each of ``parts``, (number, ids), to those of its number."""
        if not parts:
            return
        data = b"".join(ids for _, ids in parts)
        ids_of_texts = pd.DataFrame({  # noqa: F841
            "doc": np.repeat(np.array([number for number, _ in parts], np.int32), [len(ids) // 4 for _, ids in parts]),
            "pos": np.arange(len(data) // 4, dtype=np.int64),
            "token": np.frombuffer(data, np.uint32).astype(np.int32),
        })
        for doc, text in self.db.execute(_DECODE).fetchall():
            out[doc].append(np.frombuffer(text.encode("utf-16-le"), np.uint8)[::2].tobytes())


def worker_bpe(path: str, pattern: str) -> DuckBpe:
    """The encoder of this worker process; a worker has one for each file and pattern."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = DuckBpe(path, pattern)
    return _workers[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, ids (array of int) of the whole text and decoded (its bytes again).

    ``path`` is a file of ranks that every executor has, ``pattern`` the pattern that splits texts into
    words. A null or empty text has no id. Ids are those of byte-level BPE without special tokens. A text
    of any length is encoded and decoded some words and some ids at a time; an empty table gives no row.
    """
    Staging(docs.sparkSession, "bpe")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker_bpe(path, pattern)
        for batch in by_chunk(batches):
            ids = bpe.encode([text or "" for text in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": bpe.decode(ids)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, from what ``encoded`` returns."""
    return encoded(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
