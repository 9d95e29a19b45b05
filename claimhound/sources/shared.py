"""Tables written once to the shared folder and read back.

The folder is the one set for the running context, or named by
``spark.checkpoint.dir``. Only a local-mode session without either gets a
temporary folder of its own; on a cluster without it nothing is written and
callers keep their lazy plan.

Everything lives under the application's id and is deleted when its JVM ends
in order, or by ``drop_tables``. A written table cuts lineage and survives the
loss of any executor, and its real size lets Spark decide how it is joined.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from claimhound.sources.derived import (
    SOURCE_TABLES,
    derive_claims,
    derive_registry,
    table_path,
)
from claimhound.sources.schema import CLAIMS, REGISTRY

#: Whether an execution's shuffle files go when it ends, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: tempfile.TemporaryDirectory | None = None
_landed: dict[tuple, str] = {}
_landing = threading.Lock()
_deleted_at_exit: set[str] = set()


def shared_folder(spark: SparkSession) -> str | None:
    global _local_dir
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        if _local_dir is None:
            _local_dir = tempfile.TemporaryDirectory(prefix="claimhound-")
        base = _local_dir.name
    return f"{base}/claimhound/{spark.sparkContext.applicationId}" if base else None


def new_folder(spark: SparkSession, name: str) -> str | None:
    """A path in the shared folder that nothing has used yet."""
    base = shared_folder(spark)
    if base and base not in _deleted_at_exit:
        path = _path(spark, base)
        _file_system(spark, path).deleteOnExit(path)
        _deleted_at_exit.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}" if base else None


def remove_folder(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    _file_system(spark, path).delete(path, True)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is done inside, as it was before at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of path, length and modification time of every source file, at any depth."""
    digest = hashlib.sha256()
    for name in SOURCE_TABLES:
        path = _path(spark, table_path(sf_dir, name))
        files, found = _file_system(spark, path).listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join([name, *sorted(found)]).encode())
    return digest.hexdigest()


def claims_path(spark: SparkSession, sf_dir: str) -> str | None:
    """Folder of the landed claims; derives and writes them on first use."""
    return _land(spark, sf_dir, "claims", derive_claims)


def load_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = claims_path(spark, sf_dir)
    return spark.read.schema(CLAIMS).parquet(path) if path else derive_claims(spark, sf_dir)


def load_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _land(spark, sf_dir, "registry", derive_registry)
    return spark.read.schema(REGISTRY).parquet(path) if path else derive_registry(spark, sf_dir)


def _land(spark: SparkSession, sf_dir: str, name: str, derive) -> str | None:
    if shared_folder(spark) is None:
        return None
    key = (shared_folder(spark), sf_dir, name, source_state(spark, sf_dir))
    with _landing:
        if key not in _landed or not _exists(spark, f"{_landed[key]}/_SUCCESS"):
            path = new_folder(spark, name)
            with setting(spark, CLEANUP, "true"):
                derive(spark, sf_dir).write.option("compression", "zstd").parquet(path)
            _landed[key] = path
        return _landed[key]


def _exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return _file_system(spark, path).exists(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder."""
    base = shared_folder(spark)
    if base:
        remove_folder(spark, base)
