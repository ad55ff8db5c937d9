"""Token ids in fixed-width bit-packed files.

A file holds consecutive documents in ascending doc_id order. Each id takes the fewest bits that the vocabulary
needs; documents are grouped into blocks that start at a byte, and the header lists block offsets and document
lengths, so numpy unpacks a block at once and any document is read without what stands before its block.

Layout (little-endian): magic `MRBP`, u32 version, u32 width, u32 documents, u32 blocks; per block u64 first document,
u64 byte offset of its packed ids, u64 ids; per document i64 doc_id, u8 flag (1: doc_id is null), u32-pair length u64;
then the packed blocks, lowest bit first.

Texts that are null or empty hold the end id only. Documents without doc_id come last; repeated rows are written as
often as they come; equal doc_ids stand in the order of their text hash. A file is closed at FILE_IDS ids, so a very
long text makes a large file, not a large buffer of many texts. An empty table writes no file and returns no row.
Files of lost or repeated task attempts have other names and are never listed in the manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, pieces

MAGIC, VERSION = b"MRBP", 1
END_ID = 0
#: Pre-tokens whose ids a worker keeps.
CACHE = 300_000
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 23
HEAD = struct.Struct("<4sIIII")
BLOCK = np.dtype([("first", "<u8"), ("offset", "<u8"), ("ids", "<u8")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("length", "<u8")])
MANIFEST = "path string, part int, number int, n_docs long, n_ids long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, lowest bit first, filled up to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Collects documents, cuts blocks between documents, and gives the bytes of a file."""

    def __init__(self, width: int):
        self.width, self.docs, self.blocks, self.body, self.held = width, [], [], [], []
        self.n_ids = self.n_held = self.size = self.first = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._close()

    def _close(self) -> None:
        if self.held:
            data = pack(np.concatenate(self.held), self.width)
            self.blocks.append((self.first, self.size, self.n_held))
            self.body.append(data)
            self.size += len(data)
            self.held, self.n_held, self.first = [], 0, len(self.docs)

    def chunks(self) -> Iterator[bytes]:
        self._close()
        yield HEAD.pack(MAGIC, VERSION, self.width, len(self.docs), len(self.blocks))
        yield np.array(self.blocks, BLOCK).tobytes()
        yield np.array(self.docs, DOC).tobytes()
        yield from self.body


class Reader:
    """Random access to the documents of a file's bytes."""

    def __init__(self, data: bytes):
        magic, version, self.width, n_docs, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a bit-packed token file")
        at = HEAD.size
        self.blocks = np.frombuffer(data, BLOCK, n_blocks, at)
        self.docs = np.frombuffer(data, DOC, n_docs, at := at + self.blocks.nbytes)
        self.data, self.base = memoryview(data), at + self.docs.nbytes
        self.starts = np.concatenate([[0], np.cumsum(self.docs["length"].astype(np.int64))])

    def block(self, k: int) -> np.ndarray:
        """All ids of block k."""
        _, offset, n = (int(x) for x in self.blocks[k])
        return unpack(self.data[self.base + offset : self.base + offset + (n * self.width + 7) // 8], n, self.width)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i; only its block is unpacked."""
        k = int(np.searchsorted(self.blocks["first"], i, "right")) - 1
        at = int(self.starts[i] - self.starts[int(self.blocks["first"][k])])
        return self.block(k)[at : at + int(self.docs["length"][i])]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids) in file order, a block at a time."""
        for k, first in enumerate(self.blocks["first"].astype(np.int64)):
            stop = int(self.blocks["first"][k + 1]) if k + 1 < len(self.blocks) else len(self.docs)
            ids = self.block(k)
            for i in range(int(first), stop):
                at = int(self.starts[i] - self.starts[first])
                yield None if self.docs["null"][i] else int(self.docs["doc_id"][i]), int(self.starts[i]), ids[at : at + int(self.docs["length"][i])]


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all texts as bit-packed files below `directory` (a URI that every executor reaches) and returns the
    saved manifest. Ranges of doc_id are dealt out before texts are encoded, so encoding spreads over all tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = pieces.encoder(tokenizer_path, CACHE), TaskContext.get().partitionId()
        width, end = id_width(encoder.vocabulary.size), np.array([end_id], encoder.dtype)
        rows, writer = [], Writer(width)

        def close() -> None:
            nonlocal writer
            if not writer.docs:
                return
            path = f"{directory}/{part:07d}-{len(rows):05d}-{uuid.uuid4().hex}.ids"
            fs, inner = _store(path)
            size = 0
            with fs.open_output_stream(inner) as out:
                for data in writer.chunks():
                    size += len(data)
                    out.write(data)
            rows.append((path, part, len(rows), len(writer.docs), writer.n_ids, size))
            writer = Writer(width)

        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for texts in pieces.slices(batch.column(1)):
                ids, offsets = encoder.encode(texts)
                for i in range(len(texts)):
                    writer.add(keys[done + i], np.append(ids[offsets[i] : offsets[i + 1]], end))
                    if writer.n_ids >= FILE_IDS:
                        close()
                done += len(texts)
        close()
        if rows:
            names = ["path", "part", "number", "n_docs", "n_ids", "n_bytes"]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    _store(directory)[0].create_dir(_store(directory)[1], recursive=True)
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.saved(common.map_batches(ordered, write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored files."""
    import zlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = _store(path)
                with fs.open_input_file(inner) as f:
                    found = [(d, base + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) for d, at, ids in Reader(f.read())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: a table so small that one ordered window gives the running start
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.map_batches(files.repartition(parts, "path"), read, RESULT)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    directory = common.new_path(spark, "token-files")
    return read_token_files(write_token_files(common.documents(spark, sf_dir), directory, public_tokenizers.path("byte_bpe_50k.json")))
