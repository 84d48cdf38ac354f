"""Helpers that several operators share: scratch tables and schema care."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` excludes it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests, a laptop) is
    a local folder set; on a cluster, whose executors could not see it, this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clipsieve-"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches sent to Python have at most 4 MB (one longer row goes alone), unless the session has a lower bound."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = (spark.conf.get(name) or "").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def free(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of finished steps, which it keeps until the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def join_by_size(rows: DataFrame, table: DataFrame, on: list[str], size: str = "m", least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and, in ``size``, the number of ``rows`` with it.

    Keys with a 10,000th of all rows are joined by broadcast (there are 10,000 of
    them at most), so no task gets all rows of a common key; the rest by shuffle.
    """
    most = max(least, (table.agg(F.sum(size)).first()[0] or 0) // 10_000)
    many = F.broadcast(table.filter(F.col(size) > most))
    return rows.join(many, on).unionByName(rows.join(many.select(*on), on, "left_anti").join(table.filter(F.col(size) <= most), on))


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes those that no later plan reads; the others go when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already; a leftover is harmless
            pass

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
