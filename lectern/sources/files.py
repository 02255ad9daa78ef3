"""Small files and questions about paths through the file system that a path names, local or remote."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the path and renames, so that a reader sees the old file or the new one."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, doc: dict) -> None:
    """Keys in order, text as it is."""
    write_text(spark, path, json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True))


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])
