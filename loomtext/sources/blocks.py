"""From files to rows: each file is read into its blocks, and blocks go out in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of an Arrow batch, into Python and out of it.
BATCH_ROWS, BATCH_BYTES = 10_000, 2 << 20

TAGS = "array<struct<n:int,kind:string,data:string>>"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or one row, as one file may be large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _size(value) -> int:
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, (list, dict)):
        return 8 + sum(map(_size, value.values() if isinstance(value, dict) else value))
    return 8


def batches_of(batches: Iterable, reader: Callable[[object], Iterable[dict]], columns: dict[str, str]) -> Iterator:
    """Arrow batches of keys and `columns`, for batches of keys and, last, a content. Held at a time are one batch that came in,
    the blocks of one file, and blocks of about BATCH_BYTES that have not gone out."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), TAGS: pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("data", pa.string())]))}
    for b in batches:
        keys, contents = b.columns[:-1], b.column(b.num_columns - 1)
        names = [*b.schema.names[:-1], *columns]

        def made(at: list[int], rows: list[dict]):
            of = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(k.take(of) for k in keys), *(pa.array([r[c] for r in rows], kinds[t]) for c, t in columns.items())], names=names)  # noqa: B023

        at, rows, size = [], [], 0
        for i, content in enumerate(contents):
            for row in reader(content.as_py()):
                at.append(i)
                rows.append(row)
                size += _size(row)
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield made(at, rows)
                    at, rows, size = [], [], 0
        if rows:
            yield made(at, rows)


def blocks_of(files: DataFrame, keys: list[str], content: str, reader: Callable[[object], Iterable[dict]], columns: dict[str, str]) -> DataFrame:
    """(keys, columns): the blocks that reader(content) gives for each file. Keys of any kind pass through as they are."""
    bounded_batches(files.sparkSession)
    rows = files.select(*keys, content)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda batches: batches_of(batches, reader, columns), ", ".join(f"{n} {t}" for n, t in [*((k, kinds[k]) for k in keys), *columns.items()]))
