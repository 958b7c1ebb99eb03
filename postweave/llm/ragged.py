"""Words of a batch of texts as flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Flat words of all texts, and their number per text; null texts have none.

    Words end at space and tab to carriage return; ``lower`` maps A-Z alone.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and ends[-1] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = SPACES[data]
    begins = ~space
    after = np.r_[True, space[:-1]] if len(space) else space
    after[ends[:-1][ends[:-1] < len(data)]] = True
    begins &= after
    kept = data[~space]
    if lower:
        kept = LOWER[kept]
    # Places of the words among the bytes that are left.
    before = np.cumsum(~space)
    starts = before[begins] - 1
    offsets = np.r_[starts, len(kept)].astype(np.int64)
    number = np.r_[0, np.cumsum(begins)]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, np.diff(number[ends])


def gather(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` of a ragged array, which ends each row at ``ends``; their lengths."""
    starts = np.concatenate([[0], ends[:-1]])
    lengths = (ends - starts)[at]
    total = int(lengths.sum())
    shift = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return values[shift + np.arange(total)], lengths


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each ragged row, 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def portions(texts: pa.Array, most: int = 16 << 20):
    """Slices of a batch of texts with at most ``most`` bytes, or a single text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield texts.slice(start)
