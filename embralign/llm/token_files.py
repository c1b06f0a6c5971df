"""Token-id files: every document compressed on its own with a shared zstandard dictionary.

Layout of a file set (three Parquet tables in one folder, so any store Spark writes to will do and
its commit protocol makes each task's output whole or absent):

- dictionary: dict_hash (sha256 hex) and the dictionary's bytes, one row;
- segments: part, segment, first_start, blob. A blob is self-contained binary:
      magic "TOK1" | 32-byte dictionary hash | u32 documents n | u8 bytes per id, 3 zero bytes
      | n x (i64 doc_id, u64 frame offset, u32 frame length, u32 ids) | zstandard frames
  so a document is read with one index entry and one small frame;
- parts: part, ids; ids before a part follow from a sum over parts.

Documents lie in ascending doc_id order: parts are ranges of doc_id, segments follow inside a part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ._base import Scratch, partitions, read_table, ship
from ._text import small_batches
from ._tokens import encoder, tokenizer_path

MAGIC = b"TOK1"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4")])
HEAD = "<4s32sIB3x"
HEAD_SIZE = struct.calcsize(HEAD)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, *, sample_docs: int = 2000, sample_pieces: int = 2048, piece_ids: int = 2048, dict_bytes: int = 1 << 16, width: int = 2) -> bytes:
    """A zstandard dictionary from serialized ids of at most `sample_docs` documents, those with the smallest hashes.

    Documents are cut into pieces of `piece_ids` ids; of all their pieces the `sample_pieces` with the smallest
    hashes count, since training holds its sample in memory. Only the ratio depends on either bound. With too
    little text for training, the dictionary is a raw one made of the ids themselves (maybe empty).
    """
    key = F.struct("doc_id", F.xxhash64("text"))
    chosen = docs.select(F.xxhash64(key).alias("draw")).orderBy("draw").limit(sample_docs).distinct()
    rows = docs.withColumn("draw", F.xxhash64(key)).join(F.broadcast(chosen), "draw", "left_semi").select("text")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in small_batches(batches, "text"):
            ids, counts = enc.many(batch.column("text"))
            at, out = 0, []
            for c in counts.tolist():
                x = np.append(ids[at : at + c], end_id).astype(f"<u{width}")
                at += c
                out += [x[i : i + piece_ids].tobytes() for i in range(0, len(x), piece_ids)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])

    some = rows.mapInArrow(serialize, "piece binary").orderBy(F.xxhash64("piece"), "piece").limit(sample_pieces)
    pieces = sorted(bytes(r.piece) for r in some.collect())  # bounded: sample_pieces * piece_ids * width bytes
    try:
        return zstandard.train_dictionary(dict_bytes, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-dict_bytes:]


def write_token_files(
    docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, width: int = 2, segment_bytes: int = 4 << 20, parts: int | None = None, level: int = 3, sample_docs: int = 2000
) -> None:
    """docs (doc_id long, text string) -> a file set in folder; null text: the end id alone.

    Rows with a null doc_id come first; rows that share a doc_id follow each other in the order of their texts' hashes (so
    even one id on very many rows is dealt to many parts). Ids must fit in `width` bytes. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) > 256**width:
        raise ValueError(f"the vocabulary's ids don't fit in {width} bytes")
    dictionary = train_dictionary(docs, tokenizer, end_id, sample_docs=sample_docs, width=width)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value, dict_type=zstandard.DICT_TYPE_AUTO)) if shared.value else zstandard.ZstdCompressor(level=level)
        entries: list[tuple] = []
        frames: list[bytes] = []
        size = segment = start = first = 0

        def segment_row(part: int) -> pa.RecordBatch:
            blob = struct.pack(HEAD, MAGIC, digest, len(entries), width) + np.array(entries, ENTRY).tobytes() + b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([first], pa.int64()), pa.array([start - first], pa.int64()), pa.array([blob], pa.binary())], names=["part", "segment", "first_start", "ids", "blob"])

        part = 0
        for batch in small_batches(batches, "text"):
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            ids, counts = enc.many(batch.column("text"))
            at = 0
            for doc_id, c in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                frame = pack.compress(np.append(ids[at : at + c], np.uint32(end_id)).astype(f"<u{width}").tobytes())
                at += c
                entries.append((-(1 << 63) if doc_id is None else doc_id, size, len(frame), c + 1))
                frames.append(frame)
                size += len(frame)
                start += c + 1
                if size >= segment_bytes:
                    yield segment_row(part)
                    entries, frames, size, segment, first = [], [], 0, segment + 1, start
        if entries:
            yield segment_row(part)

    dealt = docs.withColumn("text_key", F.xxhash64("text")).repartitionByRange(parts or partitions(spark), "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, segment long, first_start long, ids long, blob binary").write.option("compression", "none").parquet(f"{folder}/segments")
    spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("ids").alias("ids")).coalesce(1).write.parquet(f"{folder}/parts")


def read_document(blob: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """One document's ids from a segment, without touching the other frames."""
    _, digest, n, width = struct.unpack_from(HEAD, blob)
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the segment was written with another dictionary")
    index = np.frombuffer(blob, ENTRY, n, HEAD_SIZE)
    at = int(np.searchsorted(index["doc_id"], doc_id))
    if at == n or index["doc_id"][at] != doc_id:
        return None
    return _frame(blob, index[at], HEAD_SIZE + n * ENTRY.itemsize, _unpacker(dictionary), width)


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _frame(blob: bytes, entry: np.void, base: int, unpack: zstandard.ZstdDecompressor, width: int) -> np.ndarray:
    at = base + int(entry["offset"])
    return np.frombuffer(unpack.decompress(blob[at : at + int(entry["length"])], max_output_size=int(entry["ids"]) * width), f"<u{width}")


def read_token_files(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    ship(spark)
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)
    shared = spark.sparkContext.broadcast(dictionary)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    before = spark.read.parquet(f"{folder}/parts").select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, digest = _unpacker(shared.value), hashlib.sha256(shared.value).digest()
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                blob = blob.as_py()
                magic, own, n, width = struct.unpack_from(HEAD, blob)
                if magic != MAGIC or own != digest:
                    raise ValueError("not a segment of this file set")
                index = np.frombuffer(blob, ENTRY, n, HEAD_SIZE)
                base, crc, ids = HEAD_SIZE + n * ENTRY.itemsize, [], []
                for entry in index:
                    x = _frame(blob, entry, base, unpack, width).astype("<u4")
                    crc.append(zlib.crc32(x.tobytes()))
                    if with_ids:
                        ids.append(x.astype(np.int32))
                count = index["ids"].astype(np.int64)
                doc = index["doc_id"]
                out = [pa.array(doc, mask=doc == -(1 << 63)), pa.array(first + np.cumsum(count) - count), pa.array(count), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    segments = spark.read.parquet(f"{folder}/segments").join(F.broadcast(before), "part").select((F.col("before") + F.col("first_start")).alias("first"), "blob")
    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").path("files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)
