"""Shared plumbing: stage tables in the cluster's shared folder, bounded Arrow batches, tokenizer files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts' word class [^\x20\x09-\x0D]+; bytes.split() splits on exactly these.
WORD_GAP = "\x20\x09\x0a\x0b\x0c\x0d"

#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in one process, as in tests, a temporary one where that is unset."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own_dir = _own_dir or f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        base = _own_dir
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtext_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_loomtext_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or one row, as one text may be long; the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """name with as many _ before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of any table with these columns; a null text is empty, extra columns go."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def part_rows(n_rows: int, per_part: int = 50_000) -> int:
    """How many chunks of about per_part rows hold n_rows."""
    return max(1, -(-n_rows // per_part))


def ranked(rows: DataFrame, within: list[str], order: list[str], n_rows: int) -> DataFrame:
    """rows with `rank` long: gapless from 0 within equal `within`. Numbers are given in chunks by hash, so no group is one task."""
    chunks = part_rows(n_rows)
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = rows.groupBy(*within, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*within, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    spot = Window.partitionBy(*within, "_chunk").orderBy(*order)
    rows = rows.withColumn("_spot", F.row_number().over(spot) - 1)
    return rows.join(base, [*within, "_chunk"]).withColumn("rank", (F.col("_base") + F.col("_spot")).cast("long")).drop("_chunk", "_base", "_spot")
