"""Steps that are written once to the folder which all executors share, so that what follows does not make them again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set a temporary one, if all run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here. ``options`` go to the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
