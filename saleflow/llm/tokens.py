"""Exact tokenizer ids for whole Arrow columns of texts, with a memo of white-space-delimited chunks.

Both public vocabularies used here cut a text at white space before any merge happens, so a text's ids are the
ids of its chunks put together. A worker therefore encodes each distinct chunk once (`Tokenizer.encode_batch_fast`)
and gathers the rest with numpy. Texts for which the cut isn't provably safe (special strings, and for byte-level
vocabularies runs of white space) go to the library whole, so every id is the library's own.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by one worker in each of two generations; it bounds memory, never results. Operators that hold little
#: else beside it set more.
MEMO_CHUNKS = 300_000
#: UTF-8 bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 10 << 20

#: Chunks encoded together in one text, and what stands between them: a chunk of its own.
TOGETHER, BETWEEN = 48, "\x01"

_ENCODERS: dict[tuple[str, int, int], "ChunkEncoder"] = {}


def encoder(path: str, memo_chunks: int = MEMO_CHUNKS, slice_bytes: int = SLICE_BYTES) -> "ChunkEncoder":
    """The worker's encoder of the vocabulary file at `path` (loaded once in a process)."""
    key = (path, memo_chunks, slice_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def release() -> None:
    """Give up the encoders of this worker. Spark's workers serve one stage after another: a stage that doesn't tokenize
    needn't carry the memos of one that did."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, rows) of runs of about `limit` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, i - first
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes) - first


def ragged_gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], flat[starts[1]:...], ... put together."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


#: Texts with a NUL, with white space beside other white space or at an end, or with white space other than blank
#: and newline: there a byte-level cut isn't the library's.
_OTHER_BLANKS = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_BLANKS = rf"\x00|^[ \n]|[ \n]$|[ \n][ \n]|[{_OTHER_BLANKS}]"


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in literal)


class ChunkEncoder:
    """Ids of texts as `tokenizers` gives them (add_special_tokens=False, no padding or truncation).

    Nulls count as empty texts.
    """

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, slice_bytes: int = SLICE_BYTES) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"]
        self.byte_level = pre["type"] == "ByteLevel"
        self.special = "|".join(_quoted(x["content"]) for x in spec["added_tokens"])
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 and not self.byte_level else None
        self.memo_chunks, self.slice_bytes = memo_chunks, slice_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in out]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of chunks, many of them encoded in one text, as a text of its own costs each about as much as its merges.

        The id of BETWEEN ends each chunk's ids. Where it isn't there exactly so often, chunks hold it too, and each is encoded alone.
        """
        if self.between is None:
            return self._library(words)
        texts = [f" {BETWEEN} ".join([*words[i : i + TOGETHER], ""]) for i in range(0, len(words), TOGETHER)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(ids)
        ends = np.flatnonzero(flat == self.between)
        if len(ends) != len(words):
            return self._library(words)
        data, starts = flat.tobytes(), [0, *(4 * ends + 4).tolist()]
        return [data[a : b - 4] for a, b in zip(starts, starts[1:])]

    def _chunks(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct chunks. In byte-level keys a leading NUL stands for "at the start of the text",
        and a key that starts with neither NUL nor newline has a blank before it."""
        young, old = self.young, self.old
        found: list[bytes | None] = list(map(young.get, keys))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = old.get(keys[i])
                if ids is None:
                    missing.append(i)
                else:
                    found[i] = young[keys[i]] = ids
        if missing:
            words = [keys[i] for i in missing]
            if self.byte_level:
                words = [w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else f" {w}" for w in words]
            for i, ids in zip(missing, self._joined(words), strict=True):
                found[i] = young[keys[i]] = ids
        if len(young) > self.memo_chunks:
            self.old, self.young = young, {}
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another as uint32, number of ids of each text)."""
        texts = pc.fill_null(texts, "")
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, n in text_slices(texts, self.slice_bytes):
            flat, count = self._slice(texts.slice(first, n))
            flats.append(flat)
            counts.append(count)
        return np.concatenate(flats), np.concatenate(counts)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts go to the library whole."""
        odd = pc.match_substring_regex(texts, self.special) if self.special else pa.array([False] * len(texts))
        if self.byte_level:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _ODD_BLANKS))
        return odd.to_numpy(zero_copy_only=False).astype(bool)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = self.whole(texts)
        plain = texts.filter(pa.array(~whole)) if whole.any() else texts
        if self.byte_level:
            plain = pc.replace_substring(plain, "\n", " \n")
            plain = pc.binary_join_element_wise("\0", plain, "")
        else:
            plain = pc.replace_substring(plain, "\n", " ")
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        parts = self._chunks(words.dictionary.to_numpy(zero_copy_only=False).tolist())  # texts without a scalar each
        table = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        flat = ragged_gather(table, starts[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        counts = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]
        if not whole.any():
            return flat, counts
        rest = self._library(texts.filter(pa.array(whole)).to_pylist())
        rest_counts = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        both = np.zeros(len(texts), np.int64)
        both[~whole], both[whole] = counts, rest_counts
        source = np.concatenate([flat, np.frombuffer(b"".join(rest), np.uint32)])
        begin = np.zeros(len(texts), np.int64)
        begin[~whole] = np.cumsum(counts) - counts
        begin[whole] = len(flat) + np.cumsum(rest_counts) - rest_counts
        return ragged_gather(source, begin, both), both
