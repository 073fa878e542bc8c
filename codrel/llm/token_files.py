"""Token-id files of fixed bit width: every id takes the fewest bits its vocabulary needs.

A file holds a range of documents in ascending id order::

    b"BITTOK1\\n"
    block 0, block 1, ...           ids packed low bit first, each block padded to a byte
    document ids                    int64 each
    document starts                 int64 each, ids of the file before the document, one more at the end
    block offsets                   int64 each, bytes from the start of the file, one more at the end
    footer                          width, ids per block, documents, blocks as int64; where the tables begin

All blocks but the last hold the same number of ids, so id number i lies in block i // size:
one seek reads any document. Files are written under a name of their task attempt and only
those that the manifest lists are read, so a lost executor's half-written file is never seen.

Defined results: a null or empty text holds only the end id; documents that share an id follow
each other in the order of their texts' hashes, repeated rows too, in as many files as their
number asks for; a null id is written as the smallest int64 and read back as null; a very long
text runs through several blocks of one file; an empty table gives no files and an empty
result. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, id_or_least, new_path, shuffle_partitions, text_or_empty, written

MAGIC = b"BITTOK1\n"
FOOTER = struct.Struct("<5q")
IDS_PER_BLOCK = 1 << 16
BYTES_PER_FILE = 64 << 20
_BATCH = 256


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ((ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Streams documents to one file; holds one block and the tables in memory."""

    def __init__(self, out, width: int, ids_per_block: int = IDS_PER_BLOCK):
        self.out, self.width, self.size = out, width, ids_per_block
        self.rest: list[np.ndarray] = []
        self.held = self.n = 0
        self.doc_ids: list[int] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.starts.append(self.n)
        if self.held >= self.size:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= self.size or last and at < len(ids):
            raw = pack_bits(ids[at : at + self.size], self.width)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
            at += self.size
        self.rest, self.held = [ids[at:].copy()], max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(last=True)
        tables = np.concatenate([np.array(x, "<i8") for x in (self.doc_ids, self.starts, self.offsets)])
        self.out.write(tables.astype("<i8").tobytes())
        self.out.write(FOOTER.pack(self.width, self.size, len(self.doc_ids), len(self.offsets) - 1, self.offsets[-1]))


class Reader:
    """Random access to one file: ``ids(a, b)`` reads only the blocks that hold ids a to b - 1."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        self.width, self.size, docs, blocks, at = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(at)
        tables = np.frombuffer(source.read(8 * (docs + docs + 1 + blocks + 1)), "<i8")
        self.doc_ids, self.starts, self.offsets = np.split(tables, [docs, 2 * docs + 1])

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.size, (b - 1) // self.size
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        total = int(self.starts[-1])
        out = []
        for k in range(first, last + 1):
            lo, hi = (int(self.offsets[i] - self.offsets[first]) for i in (k, k + 1))
            out.append(unpack_bits(raw[lo:hi], self.width, min(self.size, total - k * self.size)))
        return np.concatenate(out)[a - first * self.size : b - first * self.size]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, uri: str | None = None, ids_per_block: int = IDS_PER_BLOCK) -> DataFrame:
    """Writes the files and returns their manifest: path, bytes, first_doc, part, n_docs, n_ids, base (ids of earlier files).

    Range partitioning puts documents in ascending order into one file for every ``BYTES_PER_FILE``
    of text, and as many as the session has shuffle partitions at least. Ranges are cut by id, text
    hash and row, so rows that share an id are not one range. The manifest has one row a file.
    """
    spark = docs.sparkSession
    uri = uri or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        fs, top = _file_system(uri)
        part = TaskContext.get().partitionId()
        path, out, writer = f"{top}/{part:08d}-{uuid.uuid4().hex}.bin", None, None
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(path)
                    writer = Writer(out, width_of(enc.vocab_size), ids_per_block)
                some = batch.slice(at, _BATCH)
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            row = {"path": path, "bytes": fs.get_file_info(path).size, "part": part, "first_doc": writer.doc_ids[0], "n_docs": len(writer.doc_ids), "n_ids": writer.n}
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], list(row))

    source = docs.select(id_or_least().alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("hash"), F.monotonically_increasing_id().alias("row"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = ["doc_id", "hash", "row"]
    ordered = source.repartitionByRange(max(shuffle_partitions(spark), -(-size // BYTES_PER_FILE)), *key).sortWithinPartitions(*key)
    files = written(ordered.mapInArrow(write, "path string, bytes long, part int, first_doc long, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("uri", F.lit(uri))


def read_files(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf.itertuples():
                fs, _ = _file_system(file.uri)
                with fs.open_input_file(file.path) as source:
                    reader = Reader(source, file.bytes)
                    n = len(reader.doc_ids)
                    k = 0
                    while k < n:  # about a block's worth of whole documents at a time
                        to = max(k + 1, int(np.searchsorted(reader.starts, reader.starts[k] + 16 * reader.size, "right")) - 1)
                        a = int(reader.starts[k])
                        run = reader.ids(a, int(reader.starts[to]))
                        rows = []
                        for d in range(k, to):
                            own = run[int(reader.starts[d]) - a : int(reader.starts[d + 1]) - a]
                            doc_id = int(reader.doc_ids[d])
                            rows.append((None if doc_id == NO_ID else doc_id, file.base + int(reader.starts[d]), len(own), zlib.crc32(own.astype("<u4").tobytes()), *([own.tolist()] if ids else [])))
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        k = to

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    files = manifest.select("uri", "path", "bytes", "base").repartition(max(1, manifest.count()), "path")  # one task a file, more or less
    return files.mapInPandas(read, schema)
