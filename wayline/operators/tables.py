"""Cutting lineage in iterations by tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """df, written to and read from the folder that spark.checkpoint.dir names; where it is unset, a temporary
    one if Spark runs in this one process, else an error."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="wayline-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = _OWN[0]
    path = f"{folder}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
