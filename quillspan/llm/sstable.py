"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, block index, Bloom filter, footer, each
followed by one line feed. Documents stand in ascending identifier order.

* data block: entries ``shared, rest, value length`` (varints), the rest of
  the key, the value; then the number of entries and a CRC-32 (two unsigned
  32-bit integers); the whole compressed with Zstandard. Keys share prefixes
  with the key before; the first key of a block is whole.
* block index: for each block its last key, offset and length.
* Bloom filter: ten bits a key, four probes.
* footer: fixed size, with the places of index and filter, the numbers of
  documents and ids, and a magic number.

A key is 9 bytes: 0 for a null identifier or 1, then the identifier as a
big-endian integer with its sign bit flipped, so that byte order is identifier
order. A value is the document's ids as little-endian unsigned 16-bit or
32-bit integers (the footer says which).

Files are written by Spark's own text writer from one binary row a section,
and read by its binary reader: any store that Spark reaches will do, and the
committer makes retried tasks safe.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.bpe import encoder
from quillspan.llm.runtime import mapped, mix64, new_path, ship
from quillspan.llm.words import texts

MAGIC = 0x51535354
FOOTER = struct.Struct("<QQQQQQII")
BLOCK_BYTES = 64 << 10
#: Bytes of text a shard takes. A reader holds one shard: this suits executors of 3 GB, larger ones take larger shards.
SHARD_TEXT_BYTES = 24 << 20
BITS_PER_KEY, PROBES = 10, 4
#: Files whose totals are added up in one task.
FILES = 1000


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        n |= (c & 127) << shift
        at += 1
        if c < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 9)
    h = mix64(raw[:, 1:].copy().view(">u8")[:, 0].astype(np.uint64) + raw[:, 0] * np.uint64(0x9E3779B97F4A7C15))
    step = mix64(h ^ np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Sections of one shard, to be written in the order they come."""

    def __init__(self, width: int):
        self.width, self.at, self.docs, self.ids = width, 0, 0, 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def _section(self, body: bytes) -> bytes:
        self.at += len(body) + 1
        return body

    def _close_block(self) -> bytes:
        body = bytes(self.block) + struct.pack("<I", self.entries)
        body = self.pack.compress(body + struct.pack("<I", zlib.crc32(body)))
        self.index.append((self.last, self.at, len(body)))
        self.block, self.entries, self.last = bytearray(), 0, b""
        return self._section(body)

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        if self.last and key[:8] == self.last[:8]:
            shared = 8 if key != self.last else 9
        elif self.last:
            while key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            yield self._close_block()

    def finish(self) -> Iterator[bytes]:
        if self.entries:
            yield self._close_block()
        index_at = self.at
        index = self._section(b"".join(k + struct.pack("<QQ", o, n) for k, o, n in self.index))
        yield index
        bits = max(64, BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        if self.keys:
            bloom[_probes(self.keys, bits).ravel().astype(np.int64)] = True
        bloom_at = self.at
        yield self._section(np.packbits(bloom, bitorder="little").tobytes())
        yield self._section(FOOTER.pack(index_at, len(index), bloom_at, bits // 8, self.docs, self.ids, self.width, MAGIC))


class Table:
    """A shard, from its bytes or from a function that reads a range (offset, length) of them: ``entries`` in key order, or ``get`` of one key by Bloom filter and binary search, which reads footer, index, filter and one block."""

    def __init__(self, raw: bytes | Callable[[int, int], bytes], size: int | None = None):
        if callable(raw):
            self.read, self.size = raw, size
        else:
            view = memoryview(raw)
            self.read, self.size = (lambda at, n: view[at : at + n]), len(view)
        foot = self.read(self.size - FOOTER.size - 1, FOOTER.size)
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.docs, self.ids, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw_index = self.read(self.index_at, self.index_len)
        self.last_keys = [bytes(raw_index[i : i + 9]) for i in range(0, self.index_len, 25)]
        self.places = [struct.unpack("<QQ", raw_index[i + 9 : i + 25]) for i in range(0, self.index_len, 25)]
        self.unpack = zstandard.ZstdDecompressor()

    @cached_property
    def bloom(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.read(self.bloom_at, self.bloom_len), np.uint8), bitorder="little")

    def block(self, i: int) -> Iterator[tuple[bytes, memoryview]]:
        at, n = self.places[i]
        body = self.unpack.decompress(self.read(at, n))
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        view, p, key = memoryview(body), 0, b""
        for _ in range(struct.unpack("<I", body[-8:-4])[0]):
            shared, p = _read_varint(body, p)
            rest, p = _read_varint(body, p)
            size, p = _read_varint(body, p)
            key = key[:shared] + body[p : p + rest]
            yield key, view[p + rest : p + rest + size]
            p += rest + size

    def entries(self) -> Iterator[tuple[bytes, memoryview]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        key = key_of(doc_id)
        if not self.bloom[_probes([key], len(self.bloom)).ravel().astype(np.int64)].all():
            return None
        i = bisect_left(self.last_keys, key)
        if i == len(self.last_keys):
            return None
        for k, v in self.block(i):
            if k == key:
                return np.frombuffer(v, f"<u{self.width}").astype(np.uint32)
        return None


def write_tables(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards under ``path``.

    The number of shards follows the bytes of all texts. Null texts count as
    empty; every document ends with ``end_id``; special tokens in a text are
    those tokens. Texts of any length are read whole: one longer than a shard
    makes that shard longer. Rows with the same identifier all stay, in the
    order of a hash of their texts. An empty table gives no file with documents.
    Other columns are not read.
    """
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = 2 if len(enc.bytes_of) <= 1 << 16 and end_id < 1 << 16 else 4
        out, held, size = TableWriter(width), [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["section"])
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for lo, hi, data, offsets in texts(b.column(1)):
                ids, counts = enc.encode(data, offsets)
                last = np.cumsum(counts)
                ids = np.insert(ids, last, end_id).astype(f"<u{width}").tobytes()
                ends = ((last + np.arange(1, len(last) + 1)) * width).tolist()
                at = 0
                for d, e in zip(doc_ids[lo:hi], ends):
                    for section in out.add(key_of(d), ids[at:e]):
                        held.append(section)
                        size += len(section)
                    at = e
                if size > 4 << 20:
                    yield batch(held)
                    held, size = [], 0
        if out.docs:
            yield batch([*held, *out.finish()])

    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    rows.transform(mapped(write, "section binary")).select(F.col("section").cast("string")).write.text(path)


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document of the shards under ``path``, the end id included; None if there is no such document. Files are searched by halves, in each only footer and index are read, in the right one filter and a block too. Of rows that share an id one is found."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.globStatus(hadoop.Path(folder, "part-*")) or [] if f.getLen()), key=lambda f: f.getPath().getName())
    streams = []

    def table(i: int) -> Table:
        stream = fs.open(files[i].getPath())
        streams.append(stream)

        def read(at: int, n: int) -> bytes:
            stream.seek(at)
            return bytes(stream.readNBytes(n))

        return Table(read, files[i].getLen())

    try:
        key, lo, hi = key_of(doc_id), 0, len(files)
        while lo < hi:  # the first file whose last key isn't below
            mid = (lo + hi) // 2
            if table(mid).last_keys[-1] < key:
                lo = mid + 1
            else:
                hi = mid
        return table(lo).get(doc_id) if lo < len(files) else None
    finally:
        for stream in streams:
            stream.close()


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Per document of all shards under ``path``: file, doc_id, start within the file, n_tokens, ids_crc32."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if not (raw := raw.as_buffer()).size:
                    continue
                table = Table(raw)
                keys, sizes, crcs = [], [], []
                for k, v in table.entries():
                    keys.append(id_of(k))
                    sizes.append(len(v) // table.width)
                    crcs.append(zlib.crc32(v if table.width == 4 else np.frombuffer(v, "<u2").astype("<u4")))
                n = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(keys, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], ["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").transform(mapped(read, "file string, doc_id long, place long, n_tokens long, ids_crc32 long"))


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write shards to the shared folder and return per document what they hold: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. File names are in
    document order; the totals that precede each file come from one row a file,
    in two levels: before it among ``FILES`` files, and all such groups before.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_tables(docs, path, vocabulary, end_id)
    rows = read_tables(spark, path)
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"number": number, "group": F.floor(number / FILES)})
    groups = totals.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("earlier"))
    own = F.sum("n").over(Window.partitionBy("group").orderBy("number")) - F.col("n")
    before = totals.withColumn("own", own).join(groups, "group").select("file", (F.col("own") + F.col("earlier")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
