"""Word shingles of whole Arrow text columns as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts): A-Z lower-cased, words are runs of other than blank and \\t to \\r."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().dictionary_encode()
    keys = words.dictionary.to_pylist()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in keys), np.uint64, len(keys))
    real = np.fromiter(map(bool, keys), bool, len(keys))
    at = words.indices.to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    keep = real[at] if len(at) else np.zeros(0, bool)
    return each[at][keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows at each place that has k words after it."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer than k words, the whole sequence as one; else none."""
    words, offsets = word_hashes(texts)
    windows = shingle_hashes(words, k)
    out = []
    for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - first >= k:
            out.append(np.unique(windows[first : end - k + 1]))
        elif end > first:
            out.append(shingle_hashes(words[first:end], end - first))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
