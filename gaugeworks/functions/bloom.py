"""A Bloom filter that is built in the JVM, sized by the counted number of its keys, and tested in Arrow batches."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key at least: with four hashes at most 1.2 % of other keys pass.
BITS_PER_KEY = 10
HASHES = 4
#: Bits of a filter at least and at most. The largest takes 64 MB, which is what is broadcast at most, and serves 53 million keys.
LEAST_LOG2, MOST_LOG2 = 16, 29


def log2_bits(n_keys: int) -> int | None:
    """Binary logarithm of the bits that a filter of ``n_keys`` keys takes; None beyond the largest filter."""
    n = max(LEAST_LOG2, (max(n_keys, 1) * BITS_PER_KEY - 1).bit_length())
    return n if n <= MOST_LOG2 else None


def _positions(h: Column, i: int, log2: int) -> Column:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(h, 32)
    return (low + F.lit(i) * high).bitwiseAND(F.lit((1 << log2) - 1))


def bloom_words(keys: DataFrame, h: Column, log2: int) -> DataFrame:
    """(word, bits): the filter's words that aren't zero, ``2 ** log2 / 64`` rows at most; ``h`` is a 64-bit hash."""
    at = keys.select(F.explode(F.array(*[_positions(h, i, log2) for i in range(HASHES)])).alias("at"))
    return at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def bloom_filter(keys: DataFrame, h: Column, n_keys: int | None = None) -> Callable[[Column], Column] | None:
    """A test of hashes: false for keys that certainly aren't in ``keys``. The filter is broadcast.

    ``n_keys``: their number, counted if it isn't given. None if they are too many for the largest filter: then an exact
    join has to do without one.
    """
    log2 = log2_bits(keys.count() if n_keys is None else n_keys)
    if log2 is None:
        return None
    # as Arrow columns: 12 bytes a word, 100 MB for the largest filter
    found = bloom_words(keys, h, log2).toArrow()
    words = np.zeros((1 << log2) // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def might_contain(hashes: pd.Series) -> pd.Series:
        w = sent.value
        x = hashes.to_numpy(np.int64).view(np.uint64)
        low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        ok = np.ones(len(x), bool)
        for i in range(HASHES):
            at = (low + np.uint64(i) * high) & np.uint64((1 << log2) - 1)
            ok &= (w[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(ok)

    return might_contain
