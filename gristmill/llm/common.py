"""What the operators share: shared-folder materialisation, byte-level words,
Arrow helpers and the held-out rule of the labelled tables. Column names that
begin with ``__gm_`` are the operators' own."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import cut, shared_dir

__all__ = ["cut", "shared_dir"]

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Maps A-Z to a-z and leaves every other byte.
FOLD_CASE = bytes.maketrans(UPPER, LOWER)

#: Maps A-Z to a-z and every byte outside [0-9a-z\x80-\xff] to a space.
ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)).translate(FOLD_CASE)
ALNUM = bytes(c + 32 if 65 <= c <= 90 else ALNUM[c] for c in range(256))


def landed(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Computes ``df`` once, as ``cut`` does, as a Parquet table in the shared
    folder: columnar, so later readers of a few columns read only those."""
    path = f"{shared_dir(df.sparkSession)}/gristmill-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of what has been written
    and isn't referenced any more; it acts when the driver collects garbage, Python's first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Removes the table that ``landed`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("gristmill-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, not decoded."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``most`` bytes (a row at least), so that a task
    turns few texts into Python objects at a time."""
    for b in batches:
        size = max(1, most * b.num_rows // max(b.nbytes, 1))
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32 of the id as
    text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Longer texts aren't fitted on (they are scored), so that rows bound the bytes of a sample.
FIT_BYTES = 1 << 18


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows outside the held-out
    part, chosen by the hash of their id, with texts of at most FIT_BYTES: both
    bound what a model is fitted on, ``most`` what is broadcast. A repeated id
    counts once, with its greatest label and least text; rows without an id or
    a label are left out."""
    picked = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_BYTES)
    return found.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
