"""Small files of a table folder, through Hadoop's file system: the name of the current version, listing, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession

_POINTER = "CURRENT"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is no such folder."""
    p, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a file, or of the files right below a folder: it changes when they do."""
    p, fs = _at(spark, path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)))


def empty_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Paths of a folder's files without content, which Spark's readers pass over."""
    p, fs = _at(spark, path)
    return [str(x.getPath()) for x in fs.listStatus(p) if x.isFile() and not x.getLen() and x.getPath().getName().endswith(suffix)]


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist yet, seen only once it is whole; false if another writer was first."""
    p, fs = _at(spark, path)
    if fs.exists(p):
        return False
    temporary, _ = _at(spark, f"{path}.writing-{spark.sparkContext.applicationId}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    done = fs.rename(temporary, p)
    if not done:
        fs.delete(temporary, False)
    return done


def read(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Makes ``version`` the current one: pointers are numbered and the last one counts."""
    number = len([x for x in names(spark, f"{folder}/{_POINTER}") if "." not in x])
    while not write_new(spark, f"{folder}/{_POINTER}/{number:08d}", version):
        number += 1


def current(spark: SparkSession, folder: str) -> str:
    found = [x for x in names(spark, f"{folder}/{_POINTER}") if "." not in x]
    if not found:
        raise FileNotFoundError(f"{folder} has no published version")
    return read(spark, f"{folder}/{_POINTER}/{found[-1]}")
