"""Small file operations on any file system that Spark knows (paths or URIs)."""

from __future__ import annotations

import hashlib
import re
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, the default one where it names none."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``, the newest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()]
    return [name for _, name in sorted(found, reverse=True)]


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of all that lies directly in ``path``, the newest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p)]
    return [name for _, name in sorted(found, reverse=True)]


class DataFile(NamedTuple):
    name: str       # path below the folder that was listed
    length: int
    modified: int


def data_files(spark: SparkSession, path: str) -> list[DataFile]:
    """Data files under ``path`` (no marker, hidden or temporary ones), by name.
    Nothing is opened."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    root = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toUri().getPath().removeprefix(root)
        if f.getLen() and not any(part.startswith((".", "_")) for part in name.split("/")):
            out.append(DataFile(name, f.getLen(), f.getModificationTime()))
    return sorted(out)


def literal(path: str) -> str:
    """``path`` for Spark's readers, which take paths as patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the file, or of the data files under the folder."""
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) and fs.getFileStatus(p).isFile() else \
        sum(f.length for f in data_files(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """The folder or file and all below it."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at once: readers see the old text or the new one."""
    jvm = spark._jvm
    target, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    whole = fs.makeQualified(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(part), whole, how)


def version(spark: SparkSession, path: str) -> str:
    """Changes with any file under ``path``: names, sizes and times."""
    p, fs = _path(spark, path)
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()
