"""Ids of words, remembered by a worker process within a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd

REMEMBERED = 350_000
CHUNK_CHARS = 4 << 20


class WordCache:
    """Values of words that ``make`` computes for many words at once.

    Two generations of about ``remembered`` words are held: a word of the older that is met again moves
    to the younger, so that frequent words stay while rare ones go.
    """

    def __init__(self, make: Callable[[list], list[bytes]], remembered: int = REMEMBERED):
        self.make, self.remembered = make, remembered
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: Iterable) -> list[bytes]:
        """The value of each of ``words``, which are distinct."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        words = list(words)
        out, new = list(map(self.young.get, words)), []
        for k in [k for k, value in enumerate(out) if value is None]:
            out[k] = self.old.get(words[k])
            if out[k] is None:
                new.append(k)
            else:
                self.young[words[k]] = out[k]
        for k, value in zip(new, self.make([words[k] for k in new]), strict=True):
            out[k] = self.young[words[k]] = value
        return out

    def values(self, texts: list[list]) -> list[bytes]:
        """The joined values of the words of each text."""
        words = list(set().union(*texts))
        table = dict(zip(words, self.of(words), strict=True))
        return [b"".join(map(table.__getitem__, words)) for words in texts]


def by_chunk(batches: Iterable[pd.DataFrame], column: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Rows of ``batches`` in frames whose texts have about ``chars`` characters together, or one text more."""
    held, size = [], 0
    for batch in batches:
        lengths = batch[column].str.len().fillna(0).to_numpy()
        start = 0
        for k, n in enumerate(lengths):
            size += n
            if size >= chars:
                held.append(batch.iloc[start : k + 1])
                yield pd.concat(held, ignore_index=True)
                held, size, start = [], 0, k + 1
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)
