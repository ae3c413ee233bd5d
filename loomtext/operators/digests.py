"""Digests of folders: SHA-256 over an ordered stream of rows, of which none is held longer than it takes to read it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame


def _digests(rows: DataFrame, key: str, parts_of, schema: str) -> DataFrame:
    """rows (key, order, content), in order within a key, as one running digest for each key; parts_of(order, content) is what goes in."""
    import pyarrow as pa

    def run(batches):
        now, digest, size = None, None, 0
        for b in batches:
            done = []
            for k, n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, size, digest.hexdigest()))
                    now, digest, size = k, hashlib.sha256(), 0
                for part in parts_of(n, c):
                    data = b"" if part is None else part.encode() if isinstance(part, str) else bytes(part)
                    digest.update(data)
                    size += len(data)
            yield made(done, b.column(0).type)
            kind = b.column(0).type
        if digest is not None:
            yield made([(now, size, digest.hexdigest())], kind)

    def made(done, kind):
        cols = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[key, "n_bytes", "sha256"])

    return rows.mapInArrow(run, schema)


def stream_digests(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, n_bytes, sha256) of the contents of each key, joined in order; none is gathered, see folder_digests()."""
    kind = dict(rows.dtypes)[key]
    return _digests(rows.select(key, order, content).repartition(key).sortWithinPartitions(key, order), key, lambda _, c: (c,), f"{key} {kind}, n_bytes long, sha256 string")


def folder_digests(files: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """(key, sha256): the digest of name, a zero byte, content and a zero byte of each file of a folder, in the order of names (by UTF-8 bytes).

    Folders are dealt out by key and sorted; a task reads its rows in order and keeps one running digest. The files of one folder
    follow one another in one task, as the digest is defined so, but are never gathered. Null contents count as empty; a null key is a
    folder of its own.
    """
    kind = dict(files.dtypes)[key]
    rows = files.select(key, name, content).repartition(key).sortWithinPartitions(key, name)
    return _digests(rows, key, lambda n, c: (n, b"\0", c, b"\0"), f"{key} {kind}, n_bytes long, sha256 string").select(key, "sha256")
