"""Files of token ids: bit-plane shuffling.

A shard is one file. Ids are cut into chunks of a fixed number. A chunk's ids, as little-endian integers of the
shard's width, are transposed into planes: one plane per byte of the id ("byte") or per bit ("bit"). Every
plane is compressed with zstandard on its own, so the high bytes, which hardly vary, almost vanish. An index in
front names the place of every plane, so a reader can open any chunk without the others.

Layout, little-endian: magic ``PLS1``; u8 width of an id in bytes; u8 planes per id; u32 ids per chunk; u64 ids;
u32 chunks; u32 documents; u32 bytes of the document index; then for every chunk u32 crc32 of its ids (as
unsigned 32-bit integers) and u32 compressed length per plane; the document index (zstandard: all doc_ids as
i64, all id counts as u64, one byte per document that is 0 where the doc_id is null); the planes in order.

Scale: documents are range partitioned by doc_id once and encoded afterwards; a partition is cut into shards of
about ``SHARD_IDS`` ids, whole documents each. Shards are rows (part, shard, n_ids, content) of a Parquet folder,
which lets Spark commit, find and read them in any store and lets a lost task write its shards again. Global
positions are partition totals (one row per partition) added up, plus local positions.

Defined cases: a null text counts as empty; null doc_ids come first; rows with equal doc_id are ordered by a hash
of the text and by the text; a text of any length is one document of one shard; an empty table gives no shard and no row;
other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.llm.common import crc32, steps
from pairloom.llm.tokens import encoder
from pairloom.session import scratch_path

#: Ids of a shard, beyond which the next document begins another one.
SHARD_IDS = 1 << 22
#: Ids of a chunk, a multiple of eight.
CHUNK_IDS = 1 << 16

_SHARDS = "part int, shard int, n_ids long, content binary"
_HEADER = struct.Struct("<4sBBIQIII")
_MAGIC = b"PLS1"


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of some ids, lowest byte or bit first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [plane.tobytes() for plane in np.ascontiguousarray(by_byte.T)]
    by_bit = np.unpackbits(np.ascontiguousarray(by_byte), axis=1, bitorder="little")
    return [plane.tobytes() for plane in np.packbits(np.ascontiguousarray(by_bit.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ``n`` ids behind planes."""
    stacked = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) != width:
        by_bit = np.unpackbits(stacked, axis=1, bitorder="little")[:, :n]
        stacked = np.packbits(np.ascontiguousarray(by_bit.T), axis=1, bitorder="little").T
    full = np.zeros((n, 4), np.uint8)
    full[:, :width] = stacked.T
    return full.view("<u4").ravel()


def write_shard(
    doc_ids: list[int | None], ids: list[bytes], chunk_ids: int = CHUNK_IDS, bits: bool = False, level: int = 3
) -> bytes:
    """One file with the ids (as bytes of unsigned 32-bit integers) of some documents."""
    pack = zstandard.ZstdCompressor(level=level).compress
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    number = width * 8 if bits else width
    index, body = [], []
    for start in range(0, len(flat), chunk_ids):
        chunk = flat[start : start + chunk_ids]
        planes = [pack(p) for p in to_planes(chunk, width, bits)]
        index.append(struct.pack(f"<{number + 1}I", crc32(chunk.tobytes()), *map(len, planes)))
        body += planes
    counts = np.array([len(x) // 4 for x in ids], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.tobytes() + known.tobytes())
    head = _HEADER.pack(_MAGIC, width, number, chunk_ids, len(flat), len(index), len(doc_ids), len(docs))
    return b"".join([head, *index, docs, *body])


def _chunks(content: bytes):
    magic, width, number, chunk_ids, total, chunks, documents, index_bytes = _HEADER.unpack_from(content)
    if magic != _MAGIC:
        raise ValueError("not a shard of token ids")
    entry = struct.Struct(f"<{number + 1}I")
    entries = [entry.unpack_from(content, _HEADER.size + k * entry.size) for k in range(chunks)]
    docs_at = _HEADER.size + chunks * entry.size
    raw = zstandard.ZstdDecompressor().decompress(content[docs_at : docs_at + index_bytes])
    ids = np.frombuffer(raw, "<i8", documents)
    counts = np.frombuffer(raw, "<u8", documents, 8 * documents)
    known = np.frombuffer(raw, np.uint8, documents, 16 * documents)
    starts = docs_at + index_bytes + np.cumsum([0, *(sum(e[1:]) for e in entries)])
    doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
    return width, chunk_ids, total, entries, starts, doc_ids, counts.astype(np.int64)


def read_chunk(content: bytes, k: int) -> np.ndarray:
    """The ids of chunk ``k``, found by the index."""
    width, chunk_ids, total, entries, starts, _, _ = _chunks(content)
    return _one_chunk(content, k, width, chunk_ids, total, entries, starts)


def _one_chunk(content, k, width, chunk_ids, total, entries, starts) -> np.ndarray:
    unpack, at, planes = zstandard.ZstdDecompressor().decompress, int(starts[k]), []
    for length in entries[k][1:]:
        planes.append(unpack(content[at : at + length]))
        at += length
    ids = from_planes(planes, min(chunk_ids, total - k * chunk_ids), width)
    if crc32(ids.tobytes()) != entries[k][0]:
        raise ValueError(f"chunk {k} is damaged")
    return ids


def read_shard(content: bytes) -> tuple[list[int | None], list[bytes]]:
    """The doc_ids of a file and the ids of each document, as bytes of unsigned 32-bit integers."""
    width, chunk_ids, total, entries, starts, doc_ids, counts = _chunks(content)
    args = (width, chunk_ids, total, entries, starts)
    raw = b"".join(_one_chunk(content, k, *args).tobytes() for k in range(len(entries)))
    cuts = np.concatenate([[0], np.cumsum(counts)]) * 4
    return doc_ids, [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def write_documents(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS,
    chunk_ids: int = CHUNK_IDS, bits: bool = False,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, as shards in ascending doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary).encode
        part, number = TaskContext.get().partitionId(), 0
        held_docs: list[int | None] = []
        held_ids: list[bytes] = []

        def shard() -> pa.RecordBatch:
            content = write_shard(held_docs, held_ids, chunk_ids, bits)
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size]),
                pa.array([content], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SHARDS.split(", ")])

        size = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in steps(texts):
                for doc_id, raw in zip(doc_ids[low:high], encode_texts(texts[low:high])):
                    held_docs.append(doc_id)
                    held_ids.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= shard_ids:
                        yield shard()
                        held_docs, held_ids, size, number = [], [], 0, number + 1
        if held_docs:
            yield shard()

    # The hash lets rows that share one doc_id, or have none, spread over partitions.
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
        .repartitionByRange("doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark", "text")
    )
    # The planes are compressed already.
    ordered.mapInArrow(shards, _SHARDS).write.option("compression", "uncompressed").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards of a folder; ``start`` counts the ids of
    all documents before it."""
    return _decoded(spark, folder, "ids binary", lambda raw: raw, pa.binary())


def digest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_documents`` with the crc32 of the ids in place of the ids."""
    return _decoded(spark, folder, "ids_crc32 long", crc32, pa.int64())


def _decoded(spark: SparkSession, folder: str, column: str, value, kind: pa.DataType) -> DataFrame:
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, ids = read_shard(content)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                n = len(ids)
                columns = [
                    pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array([value(x) for x in ids], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, shard int, doc_id long, local long, n_tokens long, {column}"
    names = [c.split()[0] for c in schema.split(", ")]
    shards = spark.read.schema(_SHARDS).parquet(folder)
    found = shards.select("part", "shard", "content").mapInArrow(documents, schema)
    # One row per range partition, whose number follows the session's partitions: small for a single window.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    bases = shards.select("part", "shard", within.alias("within")).join(parts, "part")
    return found.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("within") + F.col("local")).alias("start"), "n_tokens", column.split()[0]
    )


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for shards, which ``session.release`` deletes with the other tables."""
    return scratch_path(spark)
