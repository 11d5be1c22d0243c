"""Session-level helpers shared by all operators: scratch tables in the shared folder and input loading."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, and it runs on one machine as in tests, a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="amphora-")
        spark.sparkContext.setCheckpointDir(path)
        path = jsc.getCheckpointDir().get()
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            _remove(spark, path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Unlike a cache its blocks aren't tied to one executor, and unlike recomputation the work is done once.
    The files are removed when the driver program ends; ``forget`` and ``scratch`` remove them sooner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/amphora/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._amphora_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    path = getattr(df, "_amphora_path", None)
    if path:
        with contextlib.suppress(Exception):
            _remove(df.sparkSession, path)


def keep(df: DataFrame) -> DataFrame:
    """Let a materialized table outlive ``scratch``."""
    _kept.add(getattr(df, "_amphora_path", ""))
    return df


@contextlib.contextmanager
def scratch():
    """Removes, at its end, the intermediate tables that were written inside; use the results before. For sessions that run for long."""
    mark = len(_written)
    try:
        yield
    finally:
        inside = _written[mark:]
        _written[mark:] = [x for x in inside if x[1] in _kept]
        for spark, path in inside:
            if path not in _kept:
                with contextlib.suppress(Exception):
                    _remove(spark, path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(c) -> F.Column:
    """Null, empty or whitespace only (Unicode white space as Python's ``str.strip`` sees it)."""
    return c.isNull() | (F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == "")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small-file table over the cluster before Python work.

    A Parquet file below ``maxPartitionBytes`` is one task whatever the work per row; tables already split finely
    enough are returned as they are, so that large inputs pay no extra shuffle.
    """
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(max(sc.defaultParallelism, 1))
