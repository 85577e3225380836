"""Token counts by a whole-token shortcut.

`whole_tokens` proves once, with the library, which vocabulary strings encode alone as exactly one token. A pre-token
found in that table counts as one without being merged; only the rest goes through the library's merges. Counts are
kept per white-space-delimited chunk (the pre-tokenizer never joins across white space), so each distinct chunk is
worked out once in a slice. The shortcut splits only chunks of Latin letters below U+0250, where lower-casing is one
character to one and normalization changes nothing; other chunks, and texts with special strings, go to the library whole.

The pattern of pre-tokens is a fixed value here; a vocabulary file with another pattern or normalizer is an error.

Nulls: a null text has no bytes and no tokens. Very long texts are counted whole, in a slice of their own. Empty table: no
rows. Repeated rows are counted each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, text_slices

#: The vocabulary's own pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_SIMPLE = regex.compile("[!-~\xa1-įı-ɏ]+")


#: Chunks in each generation of the memo, and bytes of text handled at once.
MEMO_CHUNKS, SLICE_BYTES = 400_000, 24 << 20


def _patterns(node) -> list[str]:
    """The regular expressions anywhere in a part of a vocabulary file."""
    if isinstance(node, dict):
        own = [node["Regex"]] if isinstance(node.get("Regex"), str) else []
        return own + [x for v in node.values() for x in _patterns(v)]
    return [x for v in node for x in _patterns(v)] if isinstance(node, list) else []


def check_vocabulary(path: str) -> None:
    """An error unless the file cuts texts as the shortcut takes it: lower case, white space dropped, PRE_TOKEN."""
    spec = json.loads(encoder(path).tokenizer.to_str())
    if PRE_TOKEN not in _patterns(spec["pre_tokenizer"]) or "Lowercase" not in json.dumps(spec["normalizer"]):
        raise ValueError(f"{path} has another pre-tokenizer or normalizer than the whole-token shortcut is written for")


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, lower-cased, that the vocabulary at `path` is proven to encode as one token. At most one per id."""
    check_vocabulary(path)
    ids = encoder(path)
    pre = regex.compile(PRE_TOKEN)
    texts = [x.removesuffix("</w>") for x in ids.tokenizer.get_vocab() if x.endswith("</w>")]
    texts = [x for x in texts if _SIMPLE.fullmatch(x) and x == x.lower() and pre.fullmatch(x) and pre.findall(x) == [x]]
    return frozenset(x for x, got in zip(texts, ids._library(texts), strict=True) if len(got) == 4)


class ChunkCounter:
    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.ids, self.single, self.pre = encoder(path), whole, regex.compile(PRE_TOKEN)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _merge(self, chunks: list[str]) -> None:
        """Count chunks that the memo lacks."""
        rest: dict[str, list[str]] = {}
        young, single = self.young, self.single
        for chunk in chunks:
            parts = self.pre.findall(chunk.lower()) if _SIMPLE.fullmatch(chunk) else [chunk]
            left = [x for x in parts if x not in single]
            young[chunk] = len(parts) - len(left)
            for x in left:
                rest.setdefault(x, []).append(chunk)
        for got, owners in zip(self.ids._library(list(rest)), rest.values(), strict=True):
            for chunk in owners:
                young[chunk] += len(got) // 4

    def chunks(self, keys: list[str]) -> np.ndarray:
        young, old = self.young, self.old
        missing = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            self._merge(missing)
        out = np.fromiter(map(young.__getitem__, keys), np.int64, len(keys))
        if len(young) > MEMO_CHUNKS:
            self.old, self.young = young, {}
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        out = [np.zeros(0, np.int64)]
        for first, n in text_slices(texts, SLICE_BYTES):
            part = texts.slice(first, n)
            special = self.ids.whole(part)
            counts = np.zeros(n, np.int64)
            plain = part.filter(pa.array(~special)) if special.any() else part
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
            words = lists.flatten().dictionary_encode()
            each = self.chunks(words.dictionary.to_pylist())[words.indices.to_numpy()]
            ends = np.concatenate([[0], np.cumsum(each)])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            counts[~special] = ends[offsets[1:]] - ends[offsets[:-1]]
            if special.any():
                counts[special] = [len(x) // 4 for x in self.ids._library(part.filter(pa.array(special)).to_pylist())]
            out.append(counts)
        return np.concatenate(out)


_COUNTERS: dict[str, ChunkCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether they are more than `limit`."""
    single = whole_tokens(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = ChunkCounter(tokenizer, single)
        counter = _COUNTERS[tokenizer]
        for batch in batches:
            n = counter(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, COUNTS)
