"""Staging: cut lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local-mode session without one gets a temporary folder."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Later reads neither recompute the plan above nor depend on any one executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that a loop adds to, a folder a round: what a round adds is written once, and the whole is one scan however many rounds there were."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema, self.count = spark, new_path(spark, name), None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the next round and return a scan of it; all rounds have the columns of the first."""
        df = df if self.schema is None else df.select(*self.schema.names)
        path = f"{self.path}/{self.count:06d}"
        df.write.parquet(path)
        self.schema, self.count = self.schema or df.schema, self.count + 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def release(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``; for rounds of a loop that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tessella/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _in_files(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


def anchored(df: DataFrame) -> DataFrame:
    """``df``, or a staged copy if its rows don't come straight from files: its row ids stay the same from scan to scan."""
    return df if _in_files(df) else stage(df, "rows")


def row_id(df: DataFrame) -> Column:
    """A column that names each physical row of an ``anchored`` table by file and row index, else a generated id.

    Column pruning and filters don't change it, so decisions made on a narrow projection can be joined back to
    the wide rows, repeated rows included.
    """
    if _in_files(df):
        return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row"))
