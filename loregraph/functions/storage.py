"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) is a temporary folder made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loregraph-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def spread(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` dealt by ``key`` into parts of about ``most``: a small file of many rows is otherwise one task's."""
    parts = -(-rows.count() // most)
    return rows.repartition(parts, key) if parts > 1 else rows


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``persisted`` gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["written_to"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_bucketed(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    """Write to a new folder in buckets of ``key``, each a file and sorted by it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    # dealt as the buckets are: a file each
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # its files stay


def bucketed_table(spark: SparkSession, folder: str, key: str, buckets: int) -> DataFrame:
    """The table of a folder that ``write_bucketed`` wrote, in this session or another one."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = spark.read.parquet(folder)._jdf.schema().toDDL()
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


class Made:
    """What stands for an object (a table, an adjacency) that is made when something is first asked of it."""

    def __init__(self, make: Callable[[], object]):
        self._make = make

    @property
    def is_made(self) -> bool:
        return "_made" in self.__dict__

    def made(self):
        if not self.is_made:
            self.__dict__["_made"] = self._make()
        return self.__dict__["_made"]

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.made(), name)


def later(thing, change: Callable):
    """``change(thing)``, at once or, of what is not made yet, when it is asked for."""
    return Made(lambda: change(thing.made())) if isinstance(thing, Made) else change(thing)
