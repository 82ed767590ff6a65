"""Tables in the folder that driver and executors share, to cut a long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def place(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir, or in plain local mode, where it is unset, in a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='lexigrid-')}")
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing of it."""
    path = place(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
