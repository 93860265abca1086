"""Arrow kernels that turn a batch of texts into integer word codes.

Splitting and dictionary encoding run in Arrow's C++; Python only ever sees
the distinct words of a slice.  Slices are bounded by bytes, not rows, so one
very long document cannot blow up a worker's memory with its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by a kernel.
SLICE_BYTES = 4 << 20
#: Separator of words: anything but letters, numbers and the underscore.
NON_WORD = r"[^\pL\pN_]+"


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as strings without nulls (null reads as the empty text)."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.string()), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running size of ``column`` passes ``limit`` (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # what the last batch took, workers live on


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(offsets, codes, words)``: row i has the words ``words[codes[offsets[i]:offsets[i+1]]]``.

    Empty strings at the ends of a text are dropped.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(texts) if lower else texts, NON_WORD)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = split.flatten()
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary.to_pylist()
    if "" in words:
        keep = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, words


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's span; rows without words get zeros."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A vectorised 64-bit finaliser (SplitMix64) of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
