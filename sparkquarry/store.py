"""Tables written to the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where none is named, one is made for a session that runs in this process alone; on a cluster that is an error, as executors would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sparkquarry-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Parquet looks at the size of what it holds only after 100 rows; rows of several megabytes would fill the memory until then.
_EACH_ROW = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


class Shelf:
    """Named intermediate tables of one run. A table is written once and reread, which cuts lineage: executors lost later cost no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._path(self.root)[0].deleteOnExit(self._path(self.root)[1])

    def _path(self, path: str):
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def put(self, name: str, df: DataFrame, block_bytes: int | None = None) -> DataFrame:
        """block_bytes: the size of row groups, which readers hold whole; for tables of large rows."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").options(**_EACH_ROW)
        if block_bytes:
            writer = writer.option("parquet.block.size", str(block_bytes))
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """For tables whose dependants have all been written."""
        for name in names:
            fs, p = self._path(f"{self.root}/{name}")
            fs.delete(p, True)


def bound_batches(spark) -> None:
    """Rows that go to Python at once: few, as texts may be long. Smaller settings of the session stay; plans read them only when they run, so they can't be set back here."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
