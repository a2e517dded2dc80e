"""A sampled sink that puts out each n-th row of a sequence exactly once, whatever is restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import HOUR, running_count, scan

DATA, COUNTERS = "data", "counters"


def _counted_before(spark: SparkSession, path: str, batch: int) -> tuple[DataFrame, int | None]:
    """The counters (seq_id, rows) of the last batch before this one that wrote any, and that batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/{COUNTERS}")
    fs = top.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    # a folder without its mark of success is what a stopped write has left
    done = [b for b in done if b < batch and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{COUNTERS}/batch={b}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], "seq_id long, rows long"), None
    return spark.read.schema("seq_id long, rows long").parquet(f"{path}/{COUNTERS}/batch={max(done)}"), max(done)


def sampled_sink(path: str, n: int, span: int = HOUR) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each n-th row of a sequence (seq_id, us, ...), counted over all batches, as Parquet.

    Rows are numbered by time within a batch, on from the counters that the batches before have left. Rows go to
    a folder of the batch first, counters to another after; both are written over when Spark runs a batch again,
    and its numbers begin where they did before, so a restart at any point repeats and skips nothing. Counters
    hold one row a sequence. Rows of a null sequence are left out; those of a null time come first.
    """
    if n < 1:
        raise ValueError("n must be at least 1")

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before, _ = _counted_before(spark, path, batch)
        before = before.withColumnRenamed("rows", "_before")
        numbered = scan(rows, span, _place=running_count()).join(before, "seq_id", "left")
        number = F.col("_place") + F.coalesce("_before", F.lit(0))
        numbered.where(number % n == 0).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/{DATA}/batch={batch}")
        here = rows.where("seq_id is not null").groupBy(F.col("seq_id").cast("long").alias("seq_id")).agg(F.count(F.lit(1)).alias("rows"))
        total = here.join(before, "seq_id", "full").select("seq_id", (F.coalesce("rows", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("rows"))
        total.write.mode("overwrite").parquet(f"{path}/{COUNTERS}/batch={batch}")

    return write


def read_sampled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the sink has put out; schema is that of the rows."""
    return spark.read.schema(schema + ", batch long").option("basePath", f"{path}/{DATA}").parquet(f"{path}/{DATA}").drop("batch")
