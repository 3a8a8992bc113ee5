"""Small files on any filesystem Spark can write: listing, deleting, and publishing once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of the last change in milliseconds) of what lies in a folder; nothing where there is none."""
    files, where = _place(spark, path)
    if not files.exists(where):
        return []
    return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(where)]


def delete(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _place(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file under a name that is not taken; False, and nothing written, where it is.

    The text goes to a file of its own, which is then renamed without overwriting.
    """
    jvm = spark._jvm
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    files, where = _place(spark, part)
    stream = files.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    kept = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(where, jvm.org.apache.hadoop.fs.Path(path), kept)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        files.delete(where, False)
        return False
    return True
