"""Token ids as length-delimited binary records with masked checksums and a separate offset index (operator 9).

A data file is a run of records: length (uint64), masked CRC-32 of those 8 bytes (uint32), payload, masked CRC-32 of the payload
(uint32); all little-endian. The payload is doc_id (int64), a byte that is 1 for a null doc_id, a byte with the width of an id in
bytes (2 or 4), then the ids. The index file holds the offset of each record (uint64), so a reader can fetch records in any
order. A mask is applied since a checksum of data that hold checksums is weak: (crc rotated right by 15) + 0xA282EAD8.

Files go to the shared folder, under a name of their own for each attempt, and count only by the manifest row that their task
returns, so lost executors and repeated tasks leave at most files that nothing names.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, new_path, part_rows, table, texts_of, tokenizer_path
from .tokens import word_ids

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Documents in a file, about (a file ends at twice as many); and bytes that a reader holds.
DOCS_PER_FILE, READ_BYTES = 10_000, 4 << 20
#: Ranges that tasks write; beyond, a task writes several files.
MOST_RANGES = 50_000
MANIFEST = "bucket int, part int, path string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return (None if null else doc_id), np.frombuffer(payload, np.uint16 if width == 2 else np.uint32, offset=10)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_frames(stream):
    """Payloads of a data file in order; ValueError where a length, a checksum or the end does not fit."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("damaged record")
        yield body[:size]


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a data file, by its index."""
    system, place = filesystem(path)
    with system.open_input_file(place + ".index") as f:
        (at,) = struct.unpack("<Q", f.read_at(8, 8 * k))
    with system.open_input_file(place) as f:
        f.seek(at)
        return parsed(next(read_frames(f)))


def written(docs: DataFrame, folder: str, path: str | None = None, per_file: int = DOCS_PER_FILE, end_id: int = END_ID) -> DataFrame:
    """Writes docs in ascending order of doc_id (nulls first) and then of a hash of the text, and gives the manifest: bucket and part
    (the place of the file in that order), path, n_docs, n_tokens.

    Whole texts are dealt out by ranges of both, so neither one doc_id nor one text makes a range; a task encodes its range and
    writes it.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    path = path or tokenizer_path(TOKENIZER)
    texts = texts_of(docs).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = texts.repartitionByRange(min(MOST_RANGES, part_rows(docs.count(), per_file)), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder = word_ids(path, False)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        kind = np.uint16 if width == 2 else np.uint32
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        bucket, part, data, out = TaskContext.get().partitionId(), 0, None, []

        def close():
            data.close()
            with system.open_output_stream(f"{root}/{name}.index") as f:
                f.write(np.asarray(offsets, np.uint64).tobytes())
            out.append((bucket, part, f"{folder}/{name}", len(offsets), tokens))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                if data is not None and len(offsets) >= 2 * per_file:
                    close()
                    part, data = part + 1, None
                if data is None:
                    name = f"part-{bucket:06d}-{part:06d}-{uuid.uuid4().hex}.records"
                    data, offsets, tokens, at = system.open_output_stream(f"{root}/{name}"), [], 0, 0
                own = np.append(np.frombuffer(ids, np.uint32), np.uint32(end_id)).astype(kind)
                record = frame(payload_of(doc_id, own.tobytes(), width))
                data.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(own)
        if data is not None:
            close()
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    bounded_batches(spark)
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files that the manifest names; every checksum is verified, and that each record
    lies where the index says."""
    import pyarrow as pa

    spark = manifest.sparkSession
    files = sorted(manifest.collect())  # a row for each file
    base, rows = 0, []
    for f in files:
        rows.append((f.path, base))
        base += f.n_tokens
    named = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, place = filesystem(path)
                with system.open_input_stream(place + ".index") as f:
                    offsets = np.frombuffer(f.read(), np.uint64).tolist()
                with system.open_input_stream(place, buffer_size=READ_BYTES) as f:
                    held, at = [], 0
                    for payload, offset in zip(read_frames(f), offsets, strict=True):
                        if at != offset:
                            raise ValueError("a record does not lie where the index says")
                        at += len(payload) + 16
                        doc_id, ids = parsed(payload)
                        held.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)

    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back. A null text is empty (its one id is the end id); very long texts are whole; rows with
    equal doc_id go in the order of a hash of their texts; rows with a null doc_id come first; extra columns go; an empty table gives
    no file and no row."""
    docs = table(spark, sf_dir, "documents")
    return read_back(written(docs, new_path(spark, "records")))
