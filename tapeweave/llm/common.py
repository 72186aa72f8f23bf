"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.sources.shared import shared_folder

ROWS_A_FILE = 50_000
BATCH = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share."""
    use_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a read, not a rerun.

    Where the number of rows is known, a small table goes to few files.
    """
    use_checkpoints(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(2, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """A cut for tables of many narrow rows: written as Parquet, which is denser than a checkpoint, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hand at most BATCH rows to Python at a time: texts are long, and a batch stands in memory several times over.

    The plan is made when the result is asked for, so the setting has to stay: it lowers the session's own for good.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a text column, without nulls, compressed to binary before a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([zlib.compress(x.as_py().encode(), 1) for x in batch[c]], pa.binary()) if c == column else batch[c] for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields]))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df doesn't have yet, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
