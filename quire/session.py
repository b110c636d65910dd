"""Spark session and storage helpers used by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for a context, so that a cluster needs no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._quire_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path, so any store that Spark knows works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a session on one machine doesn't name one, a temporary folder becomes the checkpoint folder. On a cluster
    that would be a folder that executors can't see, so there it is an error.
    """
    ship(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    """The scratch paths that this application has handed out and not removed."""
    sc = spark.sparkContext
    if not hasattr(sc, "_quire_made"):
        sc._quire_made = []
    return sc._quire_made


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever store it lies."""
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cleaned(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Removes at its end the scratch paths that were made within, but for ``keep``: for work whose result has been written."""
    made = _made(spark)
    before = len(made)
    yield
    for path in made[before:]:
        if path not in keep:
            remove(spark, path)
    made[before:] = [p for p in made[before:] if p in keep]


def unused(name: str, *taken: DataFrame | list[str]) -> str:
    """``name``, with as many underscores before it as no column of these has."""
    there = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in there:
        name = f"_{name}"
    return name


def written(df: DataFrame, what: str, *, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, a lost executor costs no rework."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
