"""A bitmap that tells rows apart which can't join, before they are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the bitmap's bits, as powers of two: 512 KB to 16 MB.
_LEAST, _MOST = 22, 27
_BITS_AN_ID = 16


class IdFilter:
    """The hashed values of the column of ``ids``, as a bitmap of bounded size. It never denies a value that was put in."""

    def __init__(self, ids: DataFrame, count: int = 0, hashed: bool = False):
        """``count``: about how many values there are, which sets the size; ``hashed``: they are hashes, of which the low bits do."""
        self.hashed = hashed
        self.width = 1 << min(_MOST, max(_LEAST, (count * _BITS_AN_ID).bit_length()))
        spot = self._spot(ids[ids.columns[0]])
        parts = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        bits = np.zeros(self.width, bool)
        for x in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect():
            if x.bucket == 0:  # it holds the value 0 alone
                bits[0] = True
                continue
            own = np.unpackbits(np.frombuffer(bytes(x.bits), np.uint8), bitorder="little")
            # Bucket k holds the values from (k - 1) * 32768 + 1 on.
            values = np.flatnonzero(own) + (x.bucket - 1) * len(own) + 1
            bits[values[values < self.width]] = True
        self.shared = ids.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def _spot(self, value: Column) -> Column:
        return F.pmod(value if self.hashed else F.xxhash64(value), F.lit(self.width))

    def held(self, values: np.ndarray) -> np.ndarray:
        """Which of some hashes may have been put in, within a task."""
        at = values & (self.width - 1)
        return self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0

    def __getstate__(self) -> dict:
        return {"width": self.width, "hashed": self.hashed, "shared": self.shared}

    def may_have(self, value: Column) -> Column:
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(spots: pd.Series) -> pd.Series:
            at = spots.to_numpy(np.int64)
            return pd.Series(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)

        return test(self._spot(value))

    def count_of(self, values: Column) -> Column:
        """How many of an array's values may have been put in."""
        shared = self.shared

        @F.pandas_udf("int")
        def count(spots: pd.Series) -> pd.Series:
            rows = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in spots]
            at = np.concatenate([np.zeros(0, np.int64), *rows])
            found = np.append(0, np.cumsum(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1, dtype=np.int64))
            ends = np.cumsum([len(x) for x in rows])
            return pd.Series(found[ends] - found[ends - [len(x) for x in rows]])

        return count(F.transform(values, self._spot))
