"""Vectorised word and shingle hashes inside Arrow map tasks.

Words are the runs between ASCII white space (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 4 << 20

# fixed values: the multipliers of the splitmix64 finaliser
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose text column holds about ``max_bytes``; a longer text
    is a slice of its own."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def values(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a non-null string array (much faster than
    ``to_pylist`` for many short values)."""
    _, ends, data = texts.buffers()
    if not len(texts):
        return []
    kind = "int64" if pa.types.is_large_string(texts.type) else "int32"
    at = np.frombuffer(ends, kind)[texts.offset:texts.offset + len(texts) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[x:y] for x, y in zip(at, at[1:])]


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(first word of each text and the end, distinct words, their number at
    every position) of non-null texts."""
    t = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    at = np.asarray(lists.offsets).astype("int64")
    flat = lists.flatten()
    at = at - at[0]
    if (empty := pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0).any():
        flat = flat.filter(pa.array(~empty))
        at = np.concatenate([[0], np.cumsum(~empty)])[at]
    coded = pc.dictionary_encode(flat)
    return at, values(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text and the end, word hashes) of non-null texts."""
    at, words, code = coded_words(texts, lower)
    return at, hashes(words)[code] if len(code) else np.empty(0, "uint64")


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every position on; only the first
    len - n + 1 are whole."""
    out = np.zeros(len(words), "uint64")
    for j in range(n):
        out[:len(words) - j] = out[:len(words) - j] * _STEP + words[j:]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i that has ``width`` values."""
    step, low = 1, x
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
