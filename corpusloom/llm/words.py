"""Words of whole texts as numbers, by Arrow kernels, for use inside tasks.

A batch of texts becomes one flat array of word codes with offsets per text, and the
distinct words behind the codes. What a word costs in Python is then paid once per
distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at a time; one text is never cut.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Words:
    codes: np.ndarray    # of all texts, one after the other
    offsets: np.ndarray  # where each text begins in them; one more than texts
    distinct: pa.Array   # behind the codes


def words_of(texts: pa.Array) -> Words:
    """Words at ASCII white space. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    counts = np.diff(np.asarray(parts.offsets, dtype=np.int64))
    if not pc.all(real, min_count=0).as_py():
        kept = np.asarray(real)
        sums = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        counts = sums[bounds[1:]] - sums[bounds[:-1]]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return Words(
        np.asarray(coded.indices, dtype=np.int64), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary,
    )


def blocks(batch: pa.RecordBatch, column: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text. What Arrow holds on to for later
    is given back after each batch: workers stay while others run."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = np.cumsum(sizes) // size
    starts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(sizes)]]).astype(int)
    for first, end in zip(starts[:-1], starts[1:]):
        if end > first:
            yield batch.slice(first, end - first)
    pa.default_memory_pool().release_unused()
