"""Where intermediate tables are kept.

A cluster names a shared folder in ``spark.checkpoint.dir``; that folder is read
from the session. Only when nothing is set, as in tests, is a folder chosen here.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="sightline-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Fix a frame's rows and cut its lineage in storage that outlives an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nobody has taken; False if it is taken.

    On a local folder the whole file appears at once. Elsewhere the name is taken by the file
    system's own exclusive create (atomic on HDFS) and the text is there when it is closed.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        local = fs.makeQualified(target).toUri().getPath()
        folder = os.path.dirname(local)
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" in str(problem.java_exception.getClass().getName()):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
