"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where Spark runs in this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="wayline-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], ignore_errors=True)
    return _FALLBACK[0]


class Workspace:
    """Writes intermediate tables as Parquet under the shared folder, and drops those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wayline-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._wayline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table; only for tables that no lazy plan still reads."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._wayline_path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Deletes all tables of this workspace, once nothing reads them any more."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
