"""Chunks that the memo lacks are encoded together; the ids are the library's own."""

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saleflow.llm.tokens import BETWEEN, TOGETHER, ChunkEncoder

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_chunks_are_encoded_together():
    ids_of = ChunkEncoder(WORD)
    ids_of.tokenizer = counting = Counting(ids_of.tokenizer)
    text = " ".join(f"word{i}x" for i in range(1000))
    flat, counts = ids_of(pa.array([text, None, text]))
    want = counting.tokenizer.encode(text, add_special_tokens=False).ids
    assert flat.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]
    assert counting.texts <= 1001 // TOGETHER + 1


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_chunks_have_the_library_s_ids(path):
    library = Tokenizer.from_file(path)
    odd = [BETWEEN, f"a{BETWEEN} b", f"{BETWEEN}{BETWEEN}", "", " ", "  a  b ", "́a é ́", "İstanbul İ", "don't'S 12a3", "한국어 　x", "\U0001f600‍ ﻿", "a\n\nb\tc\x00d", "<|endoftext|> x"]
    for texts in (odd, [x for x in odd if BETWEEN not in x], [" ".join(f"{x}{i}" for x in ("a", "é", "!")) for i in range(100)]):
        flat, counts = ChunkEncoder(path)(pa.array(texts))
        want = [library.encode(x, add_special_tokens=False).ids for x in texts]
        assert flat.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
