import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saleflow.llm import packing, token_counts, token_files

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text, end=None):
    got = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return got + [end] * (end is not None)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_best_fit_takes_the_tightest_window():
    windows, offsets = packing.best_fit_decreasing([10, 7, 6, 4, 3, 1], 10)
    assert windows == [0, 1, 2, 2, 1, 3] and offsets == [0, 0, 0, 6, 7, 0]


def test_packing_keeps_every_id_once(docs, rows):
    got = packing.pack_documents(docs, BYTE, 64).collect()
    want = sorted(((i is None, i), tuple(ids_of(BYTE, t, 0))) for i, t in rows if i is not None)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_length))
        by_doc[r.doc_id].append(r)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, *_ in parts] == list(np.cumsum([0] + [n for _, n, _ in parts])[:-1])
        total = sum(n for _, n, _ in parts)
        assert total <= 64 and parts[0][2] == (total if total & (total - 1) == 0 else 64)
    for (_, i), ids in dict(want).items():
        copies = sum(1 for j, _ in rows if j == i)
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in parts) == copies * len(ids) and {r.doc_tokens for r in parts} == {len(ids)}
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in parts)
    padding = 1 - sum(r.length for r in got) / (64 * len(sequences))
    assert padding < 0.02


def test_packing_with_ids_and_empty(docs, no_docs):
    r = packing.pack_documents(docs, BYTE, 64, with_ids=True).first()
    assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack_documents(no_docs, BYTE).count() == 0


def test_token_files_round_trip(docs, rows):
    got = token_files.round_trip(docs, WORD).collect()
    want = sorted(((-1 << 70 if i is None else i, t or "") for i, t in rows), key=lambda x: x[0])
    got.sort(key=lambda r: r.start)
    start = 0
    for r, (i, _) in zip(got, want, strict=True):
        assert r.start == start and (r.doc_id if r.doc_id is not None else -1 << 70) == i
        start += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), crc(x)) for x in (ids_of(WORD, t, 1) for _, t in rows))


def test_token_files_random_access(spark, docs, tmp_path):
    token_files.write_token_files(docs, f"file://{tmp_path}/f", WORD)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/f", ids=True).where("doc_id = 20").collect()
    assert [list(r.ids) for r in rows] == [ids_of(WORD, r.text, 1) for r in docs.where("doc_id = 20").collect()]


def test_token_files_empty(no_docs):
    assert token_files.round_trip(no_docs, WORD).count() == 0


def test_counts_equal_the_library(docs, rows):
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, WORD, 100).collect())
    n = [len(ids_of(WORD, t)) for _, t in rows]
    assert got == sorted((len((t or "").encode()), k, k > 100) for (_, t), k in zip(rows, n, strict=True))


def test_whole_tokens_are_proven():
    table = token_counts.whole_tokens(WORD)
    assert len(table) > 10_000
    tok = Tokenizer.from_file(WORD)
    for w in list(table)[::500]:
        assert len(tok.encode(w, add_special_tokens=False).ids) == 1


def test_counts_empty(no_docs):
    assert token_counts.count_tokens(no_docs, WORD).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunk_encoder_on_odd_texts(path):
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from saleflow.llm.tokens import encoder

    pieces = st.sampled_from(["a", "Foo", "don't", " ", "  ", "\n", "\t", "\x00", " ", "　", "é", "é", "<|endoftext|>", "1", "?!", "İ", "ς", "\x1c", "中"])

    @settings(max_examples=60, deadline=None)
    @given(st.lists(pieces, max_size=12).map("".join))
    def same(text):
        flat, counts = encoder(path)(pa.array([text, None, text]))
        want = encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
        assert flat.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]

    same()
