"""Small files next to tables: read, list, and create once, on any file system that Spark reaches."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tessera.errors import TesseraError


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that isn't there yet; the first of several writers wins, the others get CONFLICT.
    The whole text is there at once: it is written aside and then linked or created under its name."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        local = p.toUri().getPath()
        aside = f"{local}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(aside, local)
        except FileExistsError as e:
            raise TesseraError("CONFLICT", "another writer was first") from e
        finally:
            os.unlink(aside)
        return
    try:
        stream = fs.create(p, False)
    except Exception as e:
        raise TesseraError("CONFLICT", "another writer was first") from e
    stream.write(bytearray(text.encode()))
    stream.close()


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write or overwrite a file."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
