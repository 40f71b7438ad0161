"""Operator 8: token ids in binary files, document boundaries in Elias-Fano form.

A token table is a folder of Parquet rows, one for each segment. A segment is a run of
consecutive documents in ascending doc_id order with about SEGMENT_IDS ids (more only if one
document alone has more), serialised in `payload`:

    b"LLTF" | version | id width in bytes | null doc_ids | documents | ids | smallest doc_id | length of each section
    token ids, little endian, concatenated
    Elias-Fano sequence of each document's end within the segment
    Elias-Fano sequence of the doc_ids, less the smallest one

Spark's committer writes the folder, so a task that is lost and run again leaves no partial file.
A null text is empty and yields the end id alone. Null doc_ids come first; rows with the same
doc_id stay apart, ordered by a hash of the text. An empty table yields no segment.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, map_arrow, shared_dir, table, vocabulary
from ledgerloom.llm.pieces import SpacePieces

END_ID = 2
SEGMENT_IDS = 1 << 20
SELECT_EVERY = 64
MAGIC = b"LLTF"
HEAD = struct.Struct("<4sBBxxIIQq3I")
EF_HEAD = struct.Struct("<IBxxxQI")

SEGMENTS = "shard int, segment int, n_docs long, n_ids long, shard_offset long, payload binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits for each element.

    Low bits are packed; high bits stand in unary in a bit vector, of which every 64th one's
    position is kept (32 bits) so that select starts near its target."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return EF_HEAD.pack(self.n, self.low_bits, len(self.high), len(self.low)) + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_high, n_low = EF_HEAD.unpack_from(raw)
        at = EF_HEAD.size
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<u4", -(-n // SELECT_EVERY), at + n_low + n_high))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)[i]
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value, by one mark and at most 64 ones after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, need = int(self.marks[i // SELECT_EVERY]), i % SELECT_EVERY
        at = start // 8
        while True:
            bits = np.unpackbits(self.high[at : at + 64], bitorder="little")
            ones = np.flatnonzero(bits) + at * 8
            ones = ones[ones >= start]
            if len(ones) > need:
                break
            need, at, start = need - len(ones), at + 64, (at + 64) * 8
        first = i * self.low_bits
        packed = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        low = packed >> first % 8 & ((1 << self.low_bits) - 1)
        return ((int(ones[need]) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return (high << self.low_bits) | self._low(np.arange(self.n))


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; ids: each document's ids as little-endian bytes."""
    nulls = sum(x is None for x in doc_ids)
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    ends = np.cumsum([len(x) // width for x in ids])
    sections = [b"".join(ids), EliasFano.of(ends).to_bytes(), EliasFano.of(np.array([x - least for x in known], np.uint64)).to_bytes()]
    head = HEAD.pack(MAGIC, 1, width, nulls, len(doc_ids), int(ends[-1]), least, *map(len, sections))
    return head + b"".join(sections)


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, EliasFano]:
    """doc_ids, all ids, and the Elias-Fano sequence of ends."""
    magic, version, width, nulls, n, n_ids, least, *sizes = HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    at = HEAD.size
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", n_ids, at)
    ends = EliasFano.from_bytes(payload[at + sizes[0] : at + sizes[0] + sizes[1]])
    known = EliasFano.from_bytes(payload[at + sizes[0] + sizes[1] : at + sum(sizes)]).all() + least if n > nulls else []
    return [None] * nulls + [int(x) for x in known], ids, ends


def write_token_table(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the token table to path.

    Documents are range-partitioned by (doc_id, hash of text) before they are encoded: range
    bounds are found by reading the input again, which must not encode it again, and text
    compresses better in the shuffle than ids do."""
    json_path, rank_path = vocab or vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken") if vocab is None else None

    def encode(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        pieces = SpacePieces.cached(json_path, rank_path)
        width = pieces.dtype.itemsize
        end = np.array([end_id], pieces.dtype).tobytes()
        segment, offset, held, keys, rows = 0, 0, 0, [], []

        def flush():
            nonlocal segment, offset, held, keys, rows
            one = (shard, segment, len(keys), held, offset, pack_segment(keys, rows, width))
            segment, offset, held, keys, rows = segment + 1, offset + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, SEGMENT_TYPES, strict=True)], names=["shard", "segment", "n_docs", "n_ids", "shard_offset", "payload"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = pieces.encode(text.as_py()) + end
                if held and held + len(ids) // width > segment_ids:
                    yield flush()
                keys.append(key)
                rows.append(ids)
                held += len(ids) // width
        if keys:
            yield flush()

    tie = F.xxhash64("text")
    dealt = id_and_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    map_arrow(dealt, encode, SEGMENTS).write.parquet(path)


SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """From the files: each document's doc_id, start over all documents, ids and their checksum.

    Where a document lies comes from select on the Elias-Fano sequence of ends.

    What reaches the driver is one total for each shard, of which there are as many as shuffle
    partitions, however many documents there are."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    bases, total = {}, 0
    for shard, n in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        bases[shard], total = total, total + n

    def decode(batches):
        for batch in batches:
            for shard, offset, payload in zip(*(batch.column(k) for k in ("shard", "shard_offset", "payload")), strict=True):
                keys, ids, ends = unpack_segment(payload.as_py())
                stops = np.array([ends.select(k) for k in range(ends.n)])
                starts = np.concatenate([[0], stops[:-1]])
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + (bases[shard.as_py()] + offset.as_py())), pa.array(stops - starts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(segments.select("shard", "shard_offset", "payload"), decode, READ)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_table(table(spark, sf_dir, "documents"), path)
    return read_token_table(spark, path)
