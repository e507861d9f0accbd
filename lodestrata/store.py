"""Tables written in between: lineage is cut by a table in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own under a local master where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own["root"] = _own.get("root") or tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)


_folders: contextvars.ContextVar = contextvars.ContextVar("scratch", default=None)
_kept: dict[str, str] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables cut inside go to one folder, which is deleted at the end: for callers that write their result inside."""
    folder = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    token = _folders.set(folder)
    try:
        yield folder
    finally:
        _folders.reset(token)
        delete(spark, folder)


def folder(spark: SparkSession) -> str:
    """The open scratch folder, or else one a session, which Hadoop deletes when the driver ends."""
    if _folders.get():
        return _folders.get()
    app = f"{spark.sparkContext.applicationId}@{shared_dir(spark)}"
    if app not in _kept:
        _kept[app] = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
        fs, at = path_of(spark, _kept[app])
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return _kept[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once to the shared folder and read it back: later steps restart there, not at the input."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = path_of(spark, path)
    return fs.exists(at)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nothing has yet, whole or not at all; False if something has the name.

    On a local or mounted disk the draft gets its name by a hard link; elsewhere by a rename without overwriting, which HDFS and stores
    with its semantics carry out atomically. Other object stores need a conditional write of their own here.
    """
    jvm = spark._jvm
    fs, final = path_of(spark, path)
    draft = path_of(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            name = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(name(final), name(draft))
        else:
            kind = jvm.org.apache.hadoop.fs.Options.Rename
            flags = spark.sparkContext._gateway.new_array(kind, 1)
            flags[0] = kind.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), flags)
        return True
    except Py4JJavaError:
        if fs.exists(final):
            return False
        raise
    finally:
        fs.delete(draft, False)
