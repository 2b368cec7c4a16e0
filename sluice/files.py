"""Small files in the cluster's file systems: list, read, create once, delete.

PySpark has no public call for these, so this module alone reaches Hadoop's FileSystem
through the gateway.  ``create_once`` is as atomic as the file system's create without
overwrite (HDFS, ABFS, GCS and S3A with conditional writes).
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    fs, place = _at(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(place))


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        reader = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        return reader.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if it is, or if another writer was first."""
    fs, place = _at(spark, path)
    try:
        stream = fs.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    return read_text(spark, path) == text


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
