"""Words of a batch of texts as numbers: numpy and Arrow over the bytes of the whole batch.

Separators are ASCII bytes, so words of UTF-8 texts are whole. A batch is bounded by
``bounded_batches``; what is made here is a few arrays of the batch's size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only
WORD, GAP, BREAK = 0, 1, 2


class Words(NamedTuple):
    """``ids`` number the words by ``distinct``; ``doc`` is the row of the batch, ``piece`` changes at
    breaks and between rows. One entry per word, in order."""

    distinct: pa.Array
    ids: np.ndarray
    doc: np.ndarray
    piece: np.ndarray


def separators(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """Class of each byte: part of a word, between words, or between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


def split(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Words of each text, A-Z in lower case. Null counts as empty."""
    flat = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    held = flat.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = kinds[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    places = np.cumsum(inside)[starts] - 1
    offsets = np.append(places, np.count_nonzero(inside)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    coded = words.dictionary_encode()
    doc = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.cumsum(kind == BREAK)[starts]
    fresh = (np.diff(breaks, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, np.cumsum(fresh))


def hashes(words: pa.Array, seed: int = 0, before: bytes = b"") -> np.ndarray:
    """XXH64 of each word, as unsigned 64 bits."""
    return np.array([xxhash.xxh64_intdigest(before + w, seed) for w in words.to_pylist()], np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hash of ordered pairs of hashes."""
    h = left * np.uint64(0x9E3779B97F4A7C15) ^ (right << np.uint64(31) | right >> np.uint64(33)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)
