"""Token files: ids of each document as its own zstandard frame, all with one shared dictionary.

Format: a folder with `blocks` (Parquet without compression of its own) and `dictionary`. A row of `blocks` holds
about BLOCK_BYTES of frames one after another (`frames`), and for its documents, in ascending doc_id order, `doc_ids`,
`n_tokens` and `offsets` (one more than documents: frame i is frames[offsets[i]:offsets[i+1]]), the id width in bytes,
the sha256 of the dictionary that the frames need, the shard (shards ascend with doc_id), the block's number and
`tokens_before` it in its shard. A reader decodes one document from one row's index and one frame. Spark's commit
protocol writes the blocks, so a lost executor leaves no half file, and any store that Spark reaches will do.

Texts are encoded and compressed where they are read; only the frames are sorted by doc_id. A frame is never cut: one very
long text is one frame, and a block of its own if it has BLOCK_BYTES.

Nulls: a null text is empty (its end id alone); null doc_ids come first. Ties of doc_id are ordered by frame, so repeated
rows stand side by side. Empty table: no blocks, no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, saved, shared_dir
from .tokens import ChunkEncoder, encoder

BLOCKS = (
    "shard int, block int, tokens_before long, tokens long, doc_ids array<bigint>, n_tokens array<bigint>, "
    "offsets array<bigint>, frames binary, width int, dictionary_sha256 string"
)
BLOCK_BYTES = 4 << 20
#: Of the worker's encoder: it holds little else.
MEMO_CHUNKS, SLICE_BYTES = 350_000, 12 << 20
#: The dictionary is trained on at most so many documents and so many of each one's leading ids; it affects sizes only.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 2000, 64 << 10


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary of serialized id arrays; raw content where there are too few documents to train."""
    n = docs.count()
    some = docs.sample(min(1.0, 4 * SAMPLE_DOCS / max(n, 1)), seed=7).limit(SAMPLE_DOCS)
    texts = [r[0] for r in some.select(F.substring("text", 1, 8 * SAMPLE_IDS)).collect()]
    flat, counts = encoder(tokenizer)(pa.array(texts, pa.string()))
    samples = [np.append(x, end_id).astype("<u2").tobytes() for x in np.split(flat, np.cumsum(counts))[:-1]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write `docs` (doc_id, text) to the folder `path`."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, loaded = encoder(tokenizer, MEMO_CHUNKS, SLICE_BYTES), _loaded(dictionary)
        pressed = zstandard.ZstdCompressor(level=3, dict_data=loaded) if loaded else zstandard.ZstdCompressor(level=3)
        width = _width(ids_of, end_id)
        for batch in batches:
            flat, counts = ids_of(batch.column(1))
            ends = np.cumsum(counts)
            frames = [pressed.compress(np.append(flat[e - n : e], end_id).astype(f"<u{width}").tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            columns = [batch.column(0), pa.array(counts + 1), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "frame"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, width = TaskContext.get().partitionId(), _width(encoder(tokenizer, MEMO_CHUNKS, SLICE_BYTES), end_id)
        number, before = 0, 0
        doc_ids, sizes, frames, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal number, before, doc_ids, sizes, frames, held
            offsets = [0, *np.cumsum([len(x) for x in frames]).tolist()]
            row = {
                "shard": shard, "block": number, "tokens_before": before, "tokens": sum(sizes), "doc_ids": doc_ids,
                "n_tokens": sizes, "offsets": offsets, "frames": b"".join(frames), "width": width,
                "dictionary_sha256": digest,
            }
            number, before = number + 1, before + sum(sizes)
            doc_ids, sizes, frames, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for key, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids.append(key)
                sizes.append(n)
                frames.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield made()
        if frames:
            yield made()

    frames = saved(docs.mapInArrow(press, "doc_id long, n long, frame binary"), "frames", compression="uncompressed")
    ordered = frames.repartitionByRange(F.col("doc_id").asc(), F.xxhash64("frame")).sortWithinPartitions("doc_id", F.xxhash64("frame"), "frame")
    ordered.mapInArrow(block, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    forget(frames)
    spark = docs.sparkSession
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _width(ids_of: ChunkEncoder, end_id: int) -> int:
    """Bytes of an id."""
    return 2 if ids_of.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("tokens_before", pa.int64()), ("tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("frames", pa.binary()), ("width", pa.int32()), ("dictionary_sha256", pa.string()),
    ]
)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document of the folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, `ids` (array of int)."""
    dictionaries = {r.sha256: bytes(r.dictionary) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("n"))  # a row per shard, as many as write tasks
    starts = totals.select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    )
    columns = ["first", "tokens_before", "doc_ids", "n_tokens", "offsets", "frames", "width", "dictionary_sha256"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {}
        for batch in batches:
            for row in batch.to_pylist():
                digest = row["dictionary_sha256"]
                if digest not in readers:
                    loaded = _loaded(dictionaries[digest])
                    readers[digest] = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
                start, data, offsets = row["first"] + row["tokens_before"], memoryview(row["frames"]), row["offsets"]
                out: list[list] = [[], [], [], [], []]
                for i, (key, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                    got = readers[digest].decompress(data[offsets[i] : offsets[i + 1]])
                    got = np.frombuffer(got, f"<u{row['width']}").astype("<u4")
                    if len(got) != n:
                        raise ValueError(f"document {key}: {len(got)} ids, {n} in the index")
                    for column, value in zip(out, (key, start, n, zlib.crc32(got.tobytes()), got if ids else None), strict=True):
                        column.append(value)
                    start += n
                arrays = [pa.array(x, pa.int64()) for x in out[:4]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.array(out[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return blocks.join(F.broadcast(starts), "shard").select(columns).mapInArrow(decode, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write to a new shared folder, read back, one row per document."""
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
