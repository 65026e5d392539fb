"""Tables in the shared folder: intermediate ones, and ones of which each version is written whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary shared folders of local sessions without the setting, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session without that setting gets a temporary folder that goes when Python ends; a cluster
    without it is an error, as no folder of this machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="rangeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = f"file://{folder}"
    return _LOCAL_ROOTS[context.applicationId]


#: Paths below the shared folder that this Python process has given out, by application.
_GIVEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this session, once the results that read them are read; the number of paths."""
    paths = _GIVEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A Parquet table whose versions are written whole into folders of their own, and then named by one empty file.

    Readers see named versions only, so a version whose writing failed is never read. Versions older than
    the last ``keep`` ones go when a new one is named. There may be one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keep: int = 2, partition: tuple[str, ...] = ()) -> None:
        self.spark, self.folder, self.schema, self.keep, self.partition = spark, folder.rstrip("/"), schema, keep, partition

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, part: str) -> list[str]:
        fs, path = self._fs(), self._path(part)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[tuple[int, str]]:
        """(number, folder) of the named versions, oldest first."""
        return sorted((int(n), name) for n, _, name in (x.partition(".") for x in self._listed("named")) if name)

    def read(self, before: int | None = None) -> DataFrame:
        """The last version, or the last one below a number; without one, no rows."""
        found = [v for v in self.versions() if before is None or v[0] < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{found[-1][1]}")

    def replace(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """Writes and names a version, by default the next one; a number that is named already gets the new rows instead."""
        before = self.versions()
        number = (before[-1][0] + 1 if before else 0) if number is None else number
        name = uuid.uuid4().hex
        out = rows.write.partitionBy(*self.partition) if self.partition else rows.write
        out.parquet(f"{self.folder}/data/{name}")
        fs = self._fs()
        fs.create(self._path("named", f"{number:09d}.{name}"), False).close()
        last = self.versions()
        stay = sorted({n for n, _ in last})[-self.keep:]
        stale = [(n, x) for n, x in last if n not in stay or (n == number and x != name)]
        for n, old in stale:
            fs.delete(self._path("named", f"{n:09d}.{old}"), False)
            fs.delete(self._path("data", old), True)
        return self.read()
