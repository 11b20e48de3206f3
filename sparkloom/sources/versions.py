"""Versioned folders: tables are written under new names, and a small manifest, written last, says which of them count.

A version is one JSON file. It is created, never overwritten, so of two writers that start from the same version the
second fails and what it has written is read by nobody. A manifest that was broken off doesn't parse and
doesn't count either.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions at path, rising."""
    fs, p = _fs(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of the last version that was written whole; (0, {}) if there is none."""
    for n in reversed(numbers(spark, path)):
        try:
            return n, json.loads(_read(spark, f"{path}/versions/{n:010d}.json"))
        except json.JSONDecodeError:
            continue
    return 0, {}


def following(spark: SparkSession, path: str) -> int:
    """The number of the next version."""
    return (numbers(spark, path) or [0])[-1] + 1


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes a version; Conflict if there is one of that number."""
    fs, p = _fs(spark, f"{path}/versions/{number:010d}.json")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"version {number} of {path} is there already") from e
        raise
    try:
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
    finally:
        stream.close()


def parts(spark: SparkSession, path: str, schema: str, **names: list) -> DataFrame:
    """Rows of a table whose folders are named column=value, only those of the given values of one column."""
    (column, values), = names.items()
    found = [f"{path}/{column}={v}" for v in values]
    fs = _fs(spark, path)[0]
    there = [x for x in found if fs.exists(_fs(spark, x)[1])]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def fingerprint(spark: SparkSession, path: str) -> list:
    """Names, sizes and times of the files at path, for telling whether a table has changed."""
    fs, p = _fs(spark, path)
    files = fs.listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)
