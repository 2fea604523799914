"""Whole texts to numbers, many at a time: words by Arrow kernels, counts by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import offsets_of

BETWEEN = r"[^\p{L}\p{N}]+"


def lower_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word in turn, the distinct words, offsets of the texts): lower case, letters and digits."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), BETWEEN, " ")
    cut = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    offsets = cut.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = cut.flatten()
    empty = pc.equal(flat, pa.scalar("", flat.type)).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        offsets = offsets - offsets_of(empty)[offsets]
    coded = pc.dictionary_encode(flat)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each slice; 0 for an empty one."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def maxima(values: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    """Largest of each slice; `empty` for an empty one."""
    out = np.full(len(offsets) - 1, empty, np.float64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, offsets[:-1][some])
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets of the texts) of a large string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
