"""Where jobs keep intermediate tables: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: With this, the shuffle files of a query go when it ends, not only when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only where none is configured (tests, local runs) a new one is made."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, lets several consumers share one computation, gives Spark real sizes to plan with, and survives
    the loss of an executor, because the files are not kept on executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` gave, where all that is made from them has been written."""
    for df in tables:
        session = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(session._jvm.java.net.URI(folder))
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
