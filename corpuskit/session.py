"""Sessions, test-table access and fault-tolerant materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_ROOTS: dict[str, list[str]] = {}  # the folders of an application's workspaces


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuskit")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir`` of the session.

    A temporary folder of this machine stands in only where the setting is absent and the session is local.
    """
    for conf in (lambda k: spark.conf.get(k, None), lambda k: spark.sparkContext.getConf().get(k)):
        if folder := conf("spark.checkpoint.dir"):
            return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="corpuskit-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


SMALL_BYTES = 64 << 20  #: tables below this size are spread over the cores, or shuffled whole, where that is simplest


def is_small(df: DataFrame) -> bool:
    """Whether Spark expects less than SMALL_BYTES of ``df``; nothing is read for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES


def spread(df: DataFrame) -> DataFrame:
    """The same rows; a small table, which may be a single file of one row group, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


class Workspace:
    """Tables written below the shared folder: they cut lineage and outlive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def write(self, df: DataFrame, step: str) -> DataFrame:
        """Write ``df`` once and return a scan of the written table."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(step))
        return self.read(step, schema)

    def read(self, step: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(step))

    def drop(self, step: str) -> None:
        """Delete a table nothing reads any more."""
        _delete(self.spark, self.path(step))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> int:
    """Delete every table that this application's workspaces wrote to the shared folder; how many workspaces there were.

    Results that are not written or collected yet read those tables: call it when a job's results are stored.
    """
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        _delete(spark, root)
    return len(roots)
