"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where that is unset, a temporary folder, which then is the setting."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tapeweave-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, for what several branches of a plan read: they don't make it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
