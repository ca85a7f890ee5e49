"""The folder that driver and executors share, and what is kept in it for a while."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_TIDIED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder takes its place, but only under a local
    master: on a cluster the executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {context.master})")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="pointlake-")
    return _LOCAL[context.applicationId]


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name for what this application keeps; all of them go when the application ends."""
    root = f"{shared_dir(spark)}/pointlake-{spark.sparkContext.applicationId}"
    if root not in _TIDIED:
        _TIDIED.add(root)
        atexit.register(_tidy, spark, root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def _tidy(spark: SparkSession, root: str) -> None:
    local = root.rsplit("/", 1)[0]
    if local in _LOCAL.values():
        shutil.rmtree(local, ignore_errors=True)
    elif spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete(spark, root)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    files, at = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _file_system(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put a whole file in place under a name that nobody has taken; False if somebody has.

    The text goes to a temporary name first and is renamed, so that no reader sees half of it.
    A local rename replaces a file that came in between, so a hard link, which never does, takes
    its place; elsewhere the file system's rename has to refuse a taken name, as HDFS's does.
    """
    files, at = _file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = files.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    real = files.resolvePath(at).toUri()
    if real.getScheme() == "file":
        try:
            os.link(real.getPath(), os.path.join(os.path.dirname(real.getPath()), name))
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(at, False)
    if not files.exists(target) and files.rename(at, target):
        return True
    files.delete(at, False)
    return False


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address as Spark writes it, and the path in it, for use in tasks."""
    if "://" not in address:
        address = "file://" + (address[5:] if address.startswith("file:") else address)
    return fs.FileSystem.from_uri(address)
