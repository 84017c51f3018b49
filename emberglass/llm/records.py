"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A shard holds records one after another:

    length    u64   bytes of the payload
    check     u32   masked CRC-32 of the 8 length bytes
    payload         id i64, null flag u8, width u8 (2 or 4), ids (little-endian, width bytes each)
    check     u32   masked CRC-32 of the payload

All numbers are little-endian. A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that the
checksum of data that holds checksums stays sound. The index beside a shard has, for each record, u64 offset and u64
ids before it in the shard. Shards follow each other in ascending order of id; null ids come first.

A task writes its shard under a name of its own and moves it into place when complete, so a task that runs again, or
twice at once, leaves whole shards only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberglass.llm.bpe import LEAF, codec
from emberglass.llm.files import filesystem
from emberglass.llm.ranges import in_order
from emberglass.llm.text import slices

MASK = 0xA282EAD8
_HEAD, _BODY, _CHECK = struct.Struct("<QI"), struct.Struct("<qBB"), struct.Struct("<I")
_MANIFEST = "shard int, path string, n_records long, n_ids long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """The record of ids, given as little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    payload = _BODY.pack(doc_id or 0, doc_id is None, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)
    length = struct.pack("<Q", len(payload))
    return length + _CHECK.pack(masked(length)) + payload + _CHECK.pack(masked(payload))


def read_record(file) -> tuple[int | None, bytes] | None:
    """(id, ids as 32-bit integers) of the record that starts here; None at the end. A wrong checksum is an error."""
    head = file.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or _HEAD.unpack(head)[1] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = _HEAD.unpack(head)[0]
    body = file.read(n + 4)
    payload = body[:n]
    if len(body) < n + 4 or _CHECK.unpack(body[n:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    doc_id, null, width = _BODY.unpack_from(payload)
    ids = payload[_BODY.size :]
    return None if null else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def read_at(path: str, positions: list[int]) -> Iterator[tuple[int | None, bytes]]:
    """Records of one shard by number, in the order asked for, by way of its index."""
    fs, p = filesystem(path)
    with fs.open_input_file(f"{p}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").reshape(-1, 2)[:, 0]
    with fs.open_input_file(p) as f:
        for k in positions:
            f.seek(int(offsets[k]))
            yield read_record(f)


def write_records(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 8192, leaf: int = LEAF) -> DataFrame:
    """Encodes and writes all rows of docs in ascending order of id; gives the shards' manifest, lazily.

    Evaluate the result once: that writes the shards. Null and empty texts have the end id alone. Equal ids are in
    order of text. Other columns are not looked at. An empty table writes nothing and has an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        final = f"{base}/shard-{task.partitionId():05d}.bin"
        own = f"{final}.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        end = struct.pack("<I", end_id)
        at, before, index = 0, 0, []
        with fs.open_output_stream(own) as out:
            for batch in slices(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), codec(tokenizer, leaf).encode_all([t or "" for t in batch.column(1).to_pylist()])):
                    record = frame(doc_id, ids + end)
                    out.write(record)
                    index.append((at, before))
                    at, before = at + len(record), before + len(ids) // 4 + 1
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        fs.move(f"{own}.idx", f"{final}.idx")
        fs.move(own, final)
        path = f"{root}/{final.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "n_records": len(index), "n_ids": before, "bytes": at}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_order(rows, "doc_id", "text", per_range=per_shard).mapInArrow(write, _MANIFEST)


def read_records(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all shards; start counts the ids of all records before it.

    manifest is as write_records() gave it, evaluated and kept: one short row a shard, which the driver adds up.
    """
    shards = [r for r in manifest.orderBy("shard").collect() if r["n_records"]]
    starts, total = [], 0
    for r in shards:
        starts.append((r["path"], total))
        total += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                fs, p = filesystem(path)
                with fs.open_input_stream(p, buffer_size=1 << 20) as file:
                    more = True
                    while more:
                        rows = []
                        while len(rows) < 1024 and (more := (found := read_record(file)) is not None):
                            doc_id, ids = found
                            rows.append((doc_id, at, len(ids) // 4, ids))
                            at += len(ids) // 4
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])

    spark = manifest.sparkSession
    table = spark.createDataFrame(starts, "path string, start long")
    return table.repartition(max(1, len(starts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(manifest: DataFrame, seed: int = 0, n_partitions: int | None = None) -> DataFrame:
    """Rows (place, doc_id, n_tokens, ids) of all shards in a seeded random order: place counts from 0 within a partition.

    The indexes alone are read first. Every record has its partition and its place there by a hash of its shard, its
    number and the seed, and is then read by its offset, so no record's data is shuffled. Partitions are as many as
    shards if n_partitions is not given. An empty manifest gives no rows.
    """
    shards = manifest.filter("n_records > 0")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = filesystem(path)
                with fs.open_input_file(f"{p}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").reshape(-1, 2)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(np.arange(len(at))), pa.array(at)], ["path", "number", "offset"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, files = 0, {}
        try:
            for batch in slices(batches):
                rows = []
                for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if path not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        fs, p = filesystem(path)
                        files[path] = fs.open_input_file(p)
                    files[path].seek(offset)
                    doc_id, ids = read_record(files[path])
                    rows.append((place, doc_id, len(ids) // 4, ids))
                    place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["place", "doc_id", "n_tokens", "ids"])
        finally:
            for f in files.values():
                f.close()

    order = F.xxhash64("path", "number", F.lit(seed))
    found = shards.select("path").mapInArrow(offsets, "path string, number long, offset long").withColumn("order", order)
    n = n_partitions or max(1, shards.count())
    dealt = found.repartition(n, "order").sortWithinPartitions("order", "path", "number")
    return dealt.select("path", "offset").mapInArrow(read, "place long, doc_id long, n_tokens long, ids binary")
