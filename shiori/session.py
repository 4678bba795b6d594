"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "shiori", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword values override them (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local master may go without the setting (tests); then a temporary folder is made once and
    remembered in the session. On a cluster a missing setting is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.shiori.local.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="shiori-")
    spark.conf.set("spark.shiori.local.dir", folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, once per session."""
    if spark.conf.get("spark.shiori.shipped", None) is None:
        package = Path(__file__).resolve().parent
        place = tempfile.mkdtemp(prefix="shiori-")  # on the driver, which serves it to the executors
        atexit.register(shutil.rmtree, place, True)
        bundle = shutil.make_archive(f"{place}/shiori", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(bundle)
        spark.conf.set("spark.shiori.shipped", bundle)


def cut(df: DataFrame, **options) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: a cut of the lineage that
    survives lost executors. The table is removed when the driver ends, or earlier by release(). options: of the writer.

    The shuffle files of the write are dropped at its end (where this Spark can do so), so a long query
    holds the files of one step at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shiori-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._shiori_path = out._shiori_table = path
    return out


def files_of(df: DataFrame) -> list[str]:
    """The files of a table that cut() or a stored index wrote, for Python workers that read them themselves; any
    other table is written first."""
    path = getattr(df, "_shiori_table", None) or cut(df)._shiori_table
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    found = []
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(f for f in found if f.endswith(".parquet"))


_memory: dict[tuple[str, str], object] = {}


def remembered(spark: SparkSession, key: str, make):
    """What make() gave for this key in this session, made at its first use. Its tables stay until the driver ends."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _memory:
        _memory[at] = make()
    return _memory[at]


def lasting_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/shiori-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below a path: what tells whether a stored index is of this table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "|".join(sorted(found))).hex


def release(df: DataFrame) -> None:
    """Remove the table behind a result of cut() that nothing reads any more."""
    path = getattr(df, "_shiori_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def move(df: DataFrame, to: str) -> bool:
    """Move the table behind a result of cut() to another path of its file system, where it stays. False, and nothing
    done, for any other DataFrame, and where moving isn't possible. What is at the new path already is an error."""
    path = getattr(df, "_shiori_path", None)
    if not path:
        return False
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(path), hadoop.Path(to)
    conf = df.sparkSession._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(to)
    if source.getFileSystem(conf).getUri().toString() != system.getUri().toString():
        return False
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        return False
    _written[:] = [x for x in _written if x[1] != path]
    return True


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is already gone: nothing left to clean with


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
