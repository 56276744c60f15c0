"""Token ids as chunks of compressed planes.

The ids of all documents, in ascending document order, form one stream.  It is
cut into blocks of a fixed number of ids; a block is transposed into byte planes
(or bit planes), so that the nearly constant high bytes and the varied low bytes
lie apart, and each plane is compressed with zstandard by itself.  A stored row
holds a block, where it begins, and which documents it has: the rows' own
columns are the chunk index, so a reader can fetch any document's blocks.

Documents with null ids come first; equal ids keep some order of their own, and
each of their rows is a document.  Null and empty texts have the end id only; very
long texts span as many blocks as they need.  An empty table writes no chunk.
Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kerbline.llm import bpe
from kerbline.llm.arrow import bound_batches
from kerbline.plans.scratch import Scratch

# Fixed values of the block format.
MAGIC = b"KBP1"
HEAD = struct.Struct("<4sBBI")  # magic, unit (8: byte planes, 1: bit planes), planes, ids
BLOCK = 65536


def pack_block(ids: np.ndarray, unit: int = 8, level: int = 3) -> bytes:
    """Ids (unsigned 32-bit) as planes; leading planes of zeros are left out."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if unit == 8:
        planes = [raw[:, k] for k in range(max(1, (top.bit_length() + 7) // 8))]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k]) for k in range(max(1, top.bit_length()))]
    compressor = zstandard.ZstdCompressor(level=level)
    parts = [HEAD.pack(MAGIC, unit, len(planes), len(ids))]
    for plane in planes:
        data = compressor.compress(np.ascontiguousarray(plane).tobytes())
        parts += [struct.pack("<I", len(data)), data]
    return b"".join(parts)


def unpack_block(blob: bytes) -> np.ndarray:
    """The ids of a block."""
    magic, unit, count, n = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    expand, at = zstandard.ZstdDecompressor(), HEAD.size
    planes = []
    for _ in range(count):
        (size,) = struct.unpack_from("<I", blob, at)
        planes.append(np.frombuffer(expand.decompress(blob[at + 4 : at + 4 + size], max_output_size=max(1, n)), np.uint8))
        at += 4 + size
    raw = np.zeros((n, 4), np.uint8)
    if unit == 8:
        for k, plane in enumerate(planes):
            raw[:, k] = plane
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(plane, count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


PIECE = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("doc_ids", pa.int64()), ("skipped", pa.int64()), ("n", pa.int64())])
CHUNKS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("docs", pa.list_(PIECE)), ("blob", pa.binary())])
CHUNKS_DDL = "part int, chunk int, first long, n int, docs array<struct<doc_id long, ordinal long, doc_ids long, skipped long, n long>>, blob binary"


def write_ids(docs: DataFrame, path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block: int = BLOCK, unit: int = 8) -> DataFrame:
    """Encode ``docs`` with the tokenizers library, append ``end_id`` to each, and write the chunk table in ascending id order.

    Documents are range-partitioned and sorted by id, so a part is a run of the
    stream and a task holds one block and one batch.
    """
    bound_batches(docs.sparkSession)
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.library_encoder(path), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        size = first = chunk = ordinal = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, pieces, size, first, chunk
            ids = np.concatenate(held)
            row = [[part], [chunk], [first], [len(ids)], [pieces], [pack_block(ids, unit)]]
            first, chunk, held, pieces, size = first + len(ids), chunk + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, CHUNKS.types, strict=True)], schema=CHUNKS)

        for batch in batches:
            for at in range(0, batch.num_rows, bpe.SLICE):
                part_of = batch.slice(at, bpe.SLICE)
                for doc_id, packed in zip(part_of.column(0).to_pylist(), encoder([t or "" for t in part_of.column(1).to_pylist()]), strict=True):
                    ids, done = np.frombuffer(packed + end, "<u4"), 0
                    while done < len(ids):
                        take = min(len(ids) - done, block - size)
                        held.append(ids[done : done + take])
                        pieces.append({"doc_id": doc_id, "ordinal": ordinal, "doc_ids": len(ids), "skipped": done, "n": take})
                        size, done = size + take, done + take
                        if size == block:
                            yield flush()
                    ordinal += 1
        if size:
            yield flush()

    return scratch.write(ranged.mapInArrow(to_chunks, CHUNKS_DDL), "ids", codec="uncompressed")


def read_ids(chunks: DataFrame) -> DataFrame:
    """Per document, from the stored blocks: doc_id, part, ordinal, place in its part, number of ids, crc32 of its ids."""
    out = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("doc_ids", pa.int64()), ("skipped", pa.int64()), ("crc", pa.int64()), ("raw", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                part, first, docs, blob = (batch.column(n)[i].as_py() for n in ("part", "first", "docs", "blob"))
                data, at = unpack_block(blob).tobytes(), 0
                for d in docs:
                    raw = data[4 * at : 4 * (at + d["n"])]
                    whole = d["n"] == d["doc_ids"]
                    rows.append((part, d["ordinal"], d["doc_id"], first + at - d["skipped"], d["doc_ids"], d["skipped"], zlib.crc32(raw) if whole else None, None if whole else raw))
                    at += d["n"]
            columns = zip(*rows, strict=True) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    found = chunks.mapInArrow(pieces, "part int, ordinal long, doc_id long, place long, doc_ids long, skipped long, crc long, raw binary")
    # only documents that lie over a block's border are gathered; a group is one document
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("skipped", "raw"))), F.lit(b""), lambda acc, x: F.concat(acc, x["raw"]))
    torn = found.where("raw is not null").groupBy("part", "ordinal", "doc_id", "doc_ids").agg(F.min("place").alias("place"), F.crc32(joined).alias("crc"))
    names = ["part", "ordinal", "doc_id", "place", "doc_ids", "crc"]
    return found.where("raw is null").select(*names).unionByName(torn.select(*names))


def with_starts(read: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before.  Only one row a part, some tens of MB of ids each, goes through the running sum."""
    sizes = chunks.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return read.join(base, "part").withColumn("start", F.col("base") + F.col("place"))
