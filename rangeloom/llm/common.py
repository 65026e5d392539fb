"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary shared folders of local sessions without the setting, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. A local session without that setting (tests, a laptop) gets
    a temporary folder that goes when Python ends; a cluster without it is an error, as no folder of
    this machine would do.
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


#: Paths that this Python process has written below the shared folder, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what the operators of this session wrote, once their results are read; the number of paths.

    Results are lazy and read those tables, so an operator can't delete them itself.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, also no result that is still to be read."""
    for table in tables:
        for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have, whatever its case rule."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sized(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table, marked for broadcast where it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each class: ``doc_id, label, turn``.

    The rows with the least hash of their doc_id are taken, so the choice does not depend on the
    order of the table. Null labels are left out; of several labels of a document the largest
    counts. ``turn`` is a hash from 0 to 99 for splitting the rows further.
    """
    one = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    keyed = one.withColumn("_key", F.xxhash64("doc_id"))
    take = lambda c: keyed.where(F.col("label") == c).orderBy("_key", "doc_id").limit(per_class)
    return take(0).unionByName(take(1)).select("doc_id", "label", F.pmod(F.col("_key"), F.lit(100)).cast("int").alias("turn"))


def crc_of_id() -> Column:
    """crc32 of doc_id as text; of a null one, of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def fitted_logistic(z: list[float], label: list[int], default: tuple[float, float], rounds: int = 40) -> tuple[float, float]:
    """(slope, intercept) of a one-variable logistic regression; ``default`` without both classes."""
    x, y = np.asarray(z, float), np.asarray(label, float)
    if len(set(label)) < 2 or x.std() == 0:
        return default
    mean, scale = x.mean(), x.std()
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-2 * np.eye(2), a.T @ (p - y) + 1e-2 * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)
