"""Token ids in a binary format: plane shuffling.

A shard is one run of documents in ascending doc_id order. Its ids are cut into blocks of
BLOCK_IDS; a block is transposed into planes, one for each byte of an id (or one for each bit),
and every plane is compressed with zstandard on its own: the high planes hold a few values
or none and shrink to little. Layout of a shard, integers little-endian:

    b"EPL2" | planes | index | footer
    footer = <IIIQQQB: blocks, documents, documents without an id, ids, offset of index, bytes of index, plane kind (0 byte, 1 bit)
    index  = zstandard of: for each block its offset, ids and the size of each plane; then doc_ids (int64) and ids of each document

A block is read alone through the index, without those before it. Documents without a doc_id are the last of their shard, and of all.

Every shard is a file <folder>/shards/<number>.epl. A task writes it under a name of its own and moves it into place, so a
lost task leaves no half file and a second attempt writes the same; Spark's own writer commits the manifest
<folder>/manifest (shard, documents, ids), and only shards that stand there are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, qualified, scratch, small_batches, table, with_defaults
from .tokens import default_path, slices, words

MAGIC = b"EPL2"
FOOTER = "<IIIQQQB"
BLOCK_IDS = 1 << 16
SHARD_IDS = 4 << 20
LEVEL = 3


def _planes(ids: np.ndarray, bit: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, low to high, up to the last that isn't all zero."""
    b = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0))
    if bit:
        bits = np.unpackbits(b, axis=1, bitorder="little")
        return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(top.bit_length())]
    return [np.ascontiguousarray(b[:, i]).tobytes() for i in range((top.bit_length() + 7) // 8)]


def _ids(planes: list[bytes], n: int, bit: bool) -> np.ndarray:
    out = np.zeros((n, 32 if bit else 4), np.uint8)
    for i, p in enumerate(planes):
        out[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") if bit else np.frombuffer(p, np.uint8)
    return (np.packbits(out, axis=1, bitorder="little") if bit else out).view("<u4").reshape(-1).astype(np.uint32)


def encode_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bit: bool = False, nameless: int = 0) -> bytes:
    """The last nameless documents have no doc_id; what doc_ids holds for them does not matter."""
    z = zstandard.ZstdCompressor(level=LEVEL)
    body, index = [MAGIC], []
    at = len(MAGIC)
    for a in range(0, len(ids), BLOCK_IDS):
        block = ids[a : a + BLOCK_IDS]
        planes = [z.compress(p) for p in _planes(block, bit)]
        index.append(struct.pack(f"<QIB{len(planes)}I", at, len(block), len(planes), *map(len, planes)))
        body += planes
        at += sum(map(len, planes))
    tail = z.compress(b"".join(index) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes())
    return b"".join([*body, tail, struct.pack(FOOTER, len(index), len(doc_ids), nameless, len(ids), at, len(tail), bit)])


class Shard:
    """Reads a shard: doc_ids, counts, and the ids of a block or a document by the index."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        self.data, self.z = data, zstandard.ZstdDecompressor()
        n_blocks, n_docs, self.nameless, self.n_ids, at, size, self.bit = struct.unpack(FOOTER, data[-struct.calcsize(FOOTER) :])
        raw, p, self.blocks = self.z.decompress(data[at : at + size]), 0, []
        for _ in range(n_blocks):
            offset, n, k = struct.unpack_from("<QIB", raw, p)
            sizes = struct.unpack_from(f"<{k}I", raw, p + 13)
            p += 13 + 4 * k
            self.blocks.append((offset, n, sizes))
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, p)
        self.counts = np.frombuffer(raw, "<u4", n_docs, p + 8 * n_docs).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.blocks[i]
        planes = []
        for s in sizes:
            planes.append(self.z.decompress(self.data[at : at + s]))
            at += s
        return _ids(planes, n, bool(self.bit))

    def slice(self, start: int, n: int) -> np.ndarray:
        """ids [start, start + n) of the shard: only the blocks that hold them are read."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (start + n - 1) // BLOCK_IDS
        return np.concatenate([self.block(i) for i in range(first, last + 1)])[start - first * BLOCK_IDS :][:n]


MANIFEST = "shard long, documents long, ids long"


def _encode(path: str, bit: bool, folder: str):
    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        w, at = words(path), task.partitionId() << 32
        held, n = [], 0

        def shard():
            nonlocal held, n, at
            d, none, c, i = (np.concatenate(x) for x in zip(*held))
            name = f"{top}/{at:016x}.epl"
            store.create_dir(top)
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
                f.write(encode_shard(d, c, i, bit, int(none.sum())))
            store.move(f"{name}.{task.taskAttemptId()}", name)
            out = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, len(d), len(i))], names=["shard", "documents", "ids"])
            held, n, at = [], 0, at + 1
            return out

        for b in batches:
            none = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, k in slices(b.column(1)):
                ids, counts = w.encode(b.column(1).slice(a, k))
                held.append((doc_ids[a : a + k], none[a : a + k], counts, ids))
                n += len(ids)
                if n >= SHARD_IDS:
                    yield shard()
        if held:
            yield shard()
        w.clear()  # the worker lives on for other stages

    return run


def write(docs: DataFrame, to: str, tokenizer: str, bit: bool = False) -> None:
    """Writes docs(doc_id, text) in ascending order of doc_id, ties by a hash of the text; null text counts as empty.

    Rows that repeat a doc_id are documents of their own. Rows whose doc_id is null come last. An empty table
    writes no shard. Documents of any length stay whole. to is a folder that pyarrow's file systems open from every executor.
    """
    to = qualified(docs.sparkSession, to)
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    d = d.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    d.mapInArrow(_encode(tokenizer, bit, f"{to}/shards"), MANIFEST).write.parquet(f"{to}/manifest")


def _decode(batches):
    for b in batches:
        for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = Shard(data)
            names = pa.array(s.doc_ids, mask=np.arange(len(s.doc_ids)) >= len(s.doc_ids) - s.nameless)
            ends = np.cumsum(s.counts)
            crc, at = [], 0
            # blocks go by one at a time; a document may span several
            rest = np.zeros(0, np.uint32)
            doc, need, now = 0, None, 0
            for i in range(len(s.blocks)):
                ids, p = s.block(i), 0
                while doc < len(s.counts):
                    need = int(s.counts[doc]) - at
                    part = ids[p : p + need]
                    now = zlib.crc32(part.astype("<u4").tobytes(), now)
                    p += len(part)
                    at += len(part)
                    if at < s.counts[doc]:
                        break
                    crc.append(now)
                    doc, at, now = doc + 1, 0, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), number)), names, pa.array(ends - s.counts), pa.array(s.counts), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files that the manifest names."""
    path = qualified(spark, path)
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("part", F.shiftright("shard", 32))
    # a running sum over shards of some millions of ids each, in two levels: over the parts, and within a part
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    base = shards.withColumn("own", own).join(parts, "part").select("shard", (F.col("own") + F.col("ahead")).alias("base"))
    if shards.isEmpty():
        return base.select(F.col("shard").alias("doc_id"), F.col("base").alias("start"), F.col("base").alias("n_tokens"), F.col("base").alias("ids_crc32"))
    number = F.conv(F.regexp_extract("path", "([0-9a-f]{16})[.]epl$", 1), 16, 10).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epl").load(f"{path}/shards").select(number.alias("shard"), "content")
    known = files.join(shards.select("shard"), "shard", "left_semi")
    docs = known.mapInArrow(_decode, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, "shard").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark, sf_dir: str) -> DataFrame:
    to = scratch(spark, "token_shards")
    write(with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text"), to, default_path())
    return read(spark, to)
