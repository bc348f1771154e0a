"""Small files that several writers share, in any file system that Spark knows; and the folder that all of a cluster sees."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of one folder of claims.
SPAN = 1000


def opened(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = opened(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if there is no such folder."""
    p, fs = opened(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = opened(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file as a whole, unless there is one by that name: then False.  Of several writers one succeeds.

    The text is written beside it and then given the name: by a hard link on a local disk, by a rename elsewhere, which HDFS
    refuses where the name is taken.  (Object stores whose rename is a copy do not have that property.)
    """
    p, fs = opened(spark, path)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    beside = f"_{p.getName()}.{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        local = p.toUri().getPath()
        made = os.path.join(os.path.dirname(local), beside)
        with open(made, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(made, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
    made = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), beside)
    stream = fs.create(made, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.rename(made, p):
        return True
    fs.delete(made, False)
    return False


def claim(spark: SparkSession, folder: str) -> int:
    """The next number of a sequence, 1 first, that no other caller gets or has got.  A claim that is not used leaves a gap."""
    spans = [n for n in names(spark, folder) if n.isdigit()]
    last = 0
    if spans:
        last = max([int(n) for n in names(spark, f"{folder}/{spans[-1]}") if n.isdigit()], default=int(spans[-1]) * SPAN - 1)
    while True:
        last += 1
        if publish(spark, f"{folder}/{last // SPAN:012d}/{last:015d}", ""):
            return last


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one on this machine, if all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "densigrid-shared")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: what made them is not repeated, also if executors are lost."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
