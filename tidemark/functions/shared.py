"""Tables written on the way to a result, in the folder that the session names in ``spark.checkpoint.dir``.

All executors share that folder, so a lost executor costs a re-read and never
a result, and what has been written is a leaf to the optimizer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints/tidemark"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset *and* the master is a plain local one (tests) is a
    folder of this machine used; on a cluster an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for whatever store it lies in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = hadoop_path(spark, path)
    return fs.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop, fs = hadoop_path(spark, path)
    fs.delete(hadoop, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    hadoop, fs = hadoop_path(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one call writes in the shared folder.

    A written table ends the lineage before it.  At the end of the ``with``
    block all tables go but the kept ones, which the call's result reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared_path(spark, name)
        self._paths: list[str] = []
        self._kept: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        for path in self._paths:
            if kind is not None or path not in self._kept:
                remove_path(self.spark, path)

    def own_path(self, name: str, keep: bool = False) -> str:
        """A path for what one table's writer does not write."""
        path = f"{self.root}/{len(self._paths)}-{name}"
        self._paths.append(path)
        if keep:
            self._kept.add(path)
        return path

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.own_path(name, keep)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, test: Column | None = None) -> tuple[DataFrame, int]:
        """:meth:`write`, and the number of rows (for which ``test`` holds): read from the written files, whose footers count rows."""
        out = self.write(df, name)
        return out, (out if test is None else out.where(test)).count()
