"""Session factory of tests and bench (on a cluster the caller's session is used as it is), and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", app: str = "origintrace") -> SparkSession:
    """A local session with the settings the library assumes: UTC, AQE and Arrow on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}  # application id -> folder of this process, where none is set


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where one process is all there is, a folder of its own.

    The setting can't be changed in a running session, so an own folder is remembered here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="origintrace-")
        named = _own_folders[app]
    return named.rstrip("/")


_open_scopes: list[list[str]] = []


@contextmanager
def dropped_afterwards(spark: SparkSession):
    """Tables that `cut` writes inside the block are deleted at its end; what is to stay has to be written elsewhere by then."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/origintrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: its lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
