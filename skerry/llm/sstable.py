"""Sorted-string-table shards: documents' token ids by key, in prefix-compressed blocks.

A file is a sequence of blocks, a block index, a Bloom filter and a footer. An entry of a block is (shared, unshared, value length, ids), unsigned LEB128 numbers, then the unshared bytes of the key and the value; shared counts the bytes that the key has in common with the one before, 0 at a block's start. The index has, for each block, its last key, its place and size, and the entries and ids before it. Numbers of index and footer are little-endian; the footer has a fixed size and ends the file:

    index at u64 | filter at u64 | filter bits u64 | entries u64 | ids u64 | hashes u32 | magic 8 bytes

A key is a zero byte for a null identifier, or else a byte 1 and the identifier, big-endian with its sign bit flipped, so that keys sort as identifiers do; then comes the number of the row among those of the same identifier, 4 bytes. Spark's writers and readers move the bytes, so files can be in any store that Spark reaches, and a lost task's files are never seen. Each file is in a folder whose name says its first and last key and its number of ids, so a listing is enough to find the files that a key may be in.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .tokens import default_vocabulary, encoder

BLOCK_BYTES, FILE_BYTES, PART_BYTES, BITS_PER_KEY, HASHES = 4096, 16 << 20, 256 << 20, 10, 7
MAGIC = b"SKERRY1\n"  # its line feed is the one that Spark's text writer ends a row with
FOOTER = struct.Struct("<QQQQQI8s")


def _uint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")) + nth.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _bits(key: bytes, bits: int, hashes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b) % bits for k in range(hashes)]


class Writer:
    """Entries are added in the order of their keys; finish() gives the file's bytes."""

    def __init__(self):
        self.data, self.block, self.index, self.keys = bytearray(), bytearray(), [], []
        self.last, self.n, self.ids, self.before = b"", 0, 0, (0, 0)

    def __len__(self) -> int:
        return len(self.data) + len(self.block)

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if self.keys and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _uint(shared) + _uint(len(key) - shared) + _uint(len(value)) + _uint(n_ids) + key[shared:] + value
        self.keys.append(key)
        self.last, self.n, self.ids = key, self.n + 1, self.ids + n_ids
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.index.append((self.last, len(self.data), len(self.block), *self.before))
            self.data += self.block
            self.block, self.before = bytearray(), (self.n, self.ids)

    def finish(self) -> bytes:
        self._close()
        at, bits = len(self.data), max(64, BITS_PER_KEY * self.n)
        for key, where, size, n, ids in self.index:
            self.data += _uint(len(key)) + key + struct.pack("<QQQQ", where, size, n, ids)
        filter_at, bloom = len(self.data), bytearray(-(-bits // 8))
        for key in self.keys:
            for b in _bits(key, bits, HASHES):
                bloom[b >> 3] |= 1 << (b & 7)
        self.data += bloom + FOOTER.pack(at, filter_at, bits, self.n, self.ids, HASHES, MAGIC)
        return bytes(self.data)


class Table:
    """Reads a file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.index_at, self.filter_at, self.bits, self.n, self.ids, self.hashes, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a table of this format, or cut short")
        self.lasts, self.blocks, at = [], [], self.index_at
        while at < self.filter_at:
            n, at = _take(self.data, at)
            self.lasts.append(bytes(self.data[at : at + n]))
            self.blocks.append(struct.unpack_from("<QQQQ", data, at + n))
            at += n + 32

    def may_hold(self, key: bytes) -> bool:
        return all(self.data[self.filter_at + (b >> 3)] >> (b & 7) & 1 for b in _bits(key, self.bits, self.hashes))

    def block(self, k: int) -> Iterator[tuple[bytes, int, int, memoryview]]:
        """(key, ids of the file before it, its ids, value) of each entry."""
        at, size, _, ids = self.blocks[k]
        key, end = b"", at + size
        while at < end:
            shared, at = _take(self.data, at)
            rest, at = _take(self.data, at)
            length, at = _take(self.data, at)
            n, at = _take(self.data, at)
            key = key[:shared] + bytes(self.data[at : at + rest])
            at += rest
            yield key, ids, n, self.data[at : at + length]
            at, ids = at + length, ids + n

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, key: bytes) -> tuple[int, bytes] | None:
        """The number of ids and the value at key: the filter, then a binary search in the index, then one block."""
        if not self.n or not self.may_hold(key) or (k := bisect.bisect_left(self.lasts, key)) == len(self.lasts):
            return None
        return next(((n, bytes(v)) for at, _, n, v in self.block(k) if at == key), None)


def write_tables(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes documents' ids, each followed by end_id, to files under path, in ascending order of doc_id (null first) within and across files.

    documents needs doc_id (integer) and text (null: empty). Rows that repeat a doc_id come in the order of their texts, each an entry. Values are little-endian, 16 bits an id if all ids of a document fit, else 32 (the length tells). A document's entry isn't cut, so a file has file_bytes and at most one document more. An empty table writes no entry.
    """
    import pyarrow as pa

    vocabulary = vocabulary or default_vocabulary()
    parts = _parts(documents)
    ordered = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        import numpy as np

        enc, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        out, last, nth = Writer(), (), 0
        done = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary()), *[pa.array([_name(k)]) for k in (w.keys[0], w.last)], pa.array([w.ids], pa.int64())], ["file", "first", "last", "ids"])
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    nth = nth + 1 if (doc,) == last else 0
                    last = (doc,)
                    ids = np.frombuffer(ids + end, "<u4")
                    out.add(key_of(doc, nth), ids.astype("<u2").tobytes() if ids.max() < 65536 else ids.tobytes(), len(ids))
                    if len(out) >= file_bytes:
                        yield done(out)
                        out = Writer()
        if out.n:
            yield done(out)

    files = ordered.mapInArrow(run, "file binary, first string, last string, ids long")
    value = F.expr("cast(substring(file, 1, length(file) - 1) as string)").alias("value")
    files.select(value, "first", "last", "ids").write.partitionBy("first", "last", "ids").option("maxRecordsPerFile", 1).text(path)


def _name(key: bytes) -> str:
    """A key in a folder's name, which sorts as keys do and doesn't look like a number."""
    return "k" + key.hex()


def _parts(documents: DataFrame) -> int:
    """Partitions of at most about PART_BYTES of the input as Spark estimates it."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < 1 << 60 else 1, 1)


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """(content, first, last, ids) of the files: what isn't content comes from the folders' names, so it costs no reading. None if there is no file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content", "first", "last", "ids") if "first" in files.columns else None


def _table(content) -> Table:
    data = content.as_buffer().to_pybytes()
    return Table(data if data.endswith(MAGIC) else data[: data.rindex(MAGIC) + len(MAGIC)])


ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_tables(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary as unsigned 32-bit little-endian) of each entry, without the last if not asked for; start counts the ids of all entries of all files before it. Files are ordered by their first keys; their totals, a row a file, are summed in one window and meet the entries in a join."""
    import pyarrow as pa

    files = _files(spark, path)
    if files is None:
        return spark.createDataFrame([], ENTRIES).select(*[x.split()[0] for x in ENTRIES.split(", ")][: 4 + with_ids])
    names = ["first", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + with_ids]

    def entries(batches):
        import zlib

        import numpy as np

        for b in batches:
            for content, first in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                cols, size = [[] for _ in names], 0
                for key, ids_before, n, value in _table(content):
                    ids = bytes(value) if len(value) == 4 * n else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    for c, x in zip(cols, (first, id_of(key), ids_before, n, zlib.crc32(ids), ids)[: 5 + with_ids], strict=True):
                        c.append(x)
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                        cols, size = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    read = files.select("content", "first").mapInArrow(entries, "first string, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("first", before.cast("long").alias("before"))  # the first keys of files differ
    return read.join(starts, "first").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked documents (first of each identifier). Only files whose keys may include one are read, by the folders' names; in each of them the filter, a binary search of the index and one block answer."""
    import pyarrow as pa

    keys = [(d, key_of(d)) for d in sorted(set(doc_ids))]
    files = _files(spark, path)
    if files is None or not keys:
        return spark.createDataFrame([], "doc_id long, ids binary")
    inside = F.lit(False)
    for _, key in keys:
        inside = inside | ((F.col("first") <= _name(key)) & (F.col("last") >= _name(key)))

    def run(batches):
        import numpy as np

        for b in batches:
            for content in b.column(0):
                t, rows = _table(content), []
                for d, key in keys:
                    if (found := t.get(key)) is not None:
                        n, value = found
                        rows.append((d, value if len(value) == 4 * n else np.frombuffer(value, "<u2").astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["doc_id", "ids"])

    return files.filter(inside).select("content").mapInArrow(run, "doc_id long, ids binary")


def op6_sstable(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sstable")
    write_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tables(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
