"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quietlog")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; on a local master, where it may be unset, a temporary one.

    Executors of a cluster do not see the driver's disk, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.sparkContext.applicationId
    if own not in _own:
        _own[own] = tempfile.mkdtemp(prefix="quietlog-")
    return _own[own]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; `release` or the end of the driver removes the folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextlib.contextmanager
def made_here(spark: SparkSession) -> Iterator[list[str]]:
    """The scratch folders that come into being inside."""
    before, paths = {p for _, p in _made}, []
    yield paths
    paths += [p for s, p in _made if s is spark and p not in before]


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove these, or all, scratch folders of the session; results that still read them are not to be used any more."""
    for entry in [e for e in _made if e[0] is spark and (paths is None or e[1] in paths)]:
        _made.remove(entry)
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        with contextlib.suppress(Exception):  # a stopped session or a closed gateway
            release(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back: for results with several readers.

    A lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are done now, not when the driver next collects its garbage.

    For operators of several large steps, each of which has been staged: the files of one would stand beside the next one's.
    """
    for _ in range(2):  # the driver's Python lets go of a plan a moment after it has collected it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def spread(df: DataFrame) -> DataFrame:
    """On a local master, give costly column work at least one partition per core; on a cluster, nothing.

    Small local tables are single row groups, which no reader setting can split. A cluster's inputs have splits enough.
    """
    if not is_local(df.sparkSession):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
