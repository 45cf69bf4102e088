"""Word windows as numbers: words are hashed by Spark, windows by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictflow.llm.common import words

SHORT = 5
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2 ** 64


def word_hashes(text: Column) -> Column:
    """A 64-bit number per word: 63 bits of hash, the lowest bit set for words under ``SHORT`` letters."""
    return F.transform(words(text), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(w) < SHORT).cast("long")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a batch and where each document's begin and end."""
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


class Windows:
    """Hashes of any window of a batch's words, by sums of powers modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: int = _B1) -> None:
        size = len(values) + 1
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1], dtype=np.uint64)])
        inverse = pow(base, -1, 1 << 64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def two_hashes(values: np.ndarray) -> tuple[Windows, Windows]:
    return Windows(values, _B1), Windows(values, _B2)


def starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``size`` words begin, and the document of each."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    document = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][document] + within, document
