"""Numbers for the words of text columns, made by Arrow's kernels instead of a Python step per word.

A column is split and dictionary-encoded in C++; Python sees each distinct word of a batch
once. Word ids of a batch follow the order of first sight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts_of(col) -> pa.Array:
    """A text column as plain strings, null as empty."""
    return pc.fill_null(col.cast(pa.string()), "")


def numbered(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of every element, distinct elements, elements per row) of a list column
    without nulls; a list column may be a slice."""
    counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def words(col) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every text: (word numbers, distinct words, words per
    text). Null texts have none."""
    ids, distinct, counts = numbered(pc.ascii_split_whitespace(texts_of(col)))
    # white space at the ends and empty texts leave empty strings
    empty = pc.index(distinct, pa.scalar("")).as_py()
    if empty < 0:
        return ids, distinct, counts
    real = ids != empty
    counts = np.add.reduceat(np.append(real, False), np.concatenate([[0], np.cumsum(counts)[:-1]]), dtype=np.int64) * (counts > 0) if len(counts) else counts
    ids = ids[real]
    return ids - (ids > empty), pa.concat_arrays([distinct[:empty], distinct[empty + 1:]]), counts


def slices(col, size: int):
    """Consecutive row ranges of a text column of about ``size`` bytes, one row at least."""
    n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, m in enumerate(n.tolist()):
        held += m
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(n):
        yield lo, len(n)
