"""Session defaults.  Everything here can be overridden by the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "callbrook", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only when ``spark.checkpoint.dir`` is unset and executors run in this very
    process (a local test) a temporary folder is chosen and recorded; on a
    cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


_scopes: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: a table that several later
    steps read is computed once, and losing an executor loses none of it.
    Inside ``temporary()`` the table goes at the end; one to be kept lives on
    in the scope around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(out)
    return out


def discard(table: DataFrame) -> None:
    """Remove a table that ``written`` made and nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(conf).delete(path, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables written inside are removed when it ends: what leaves it must be a kept table.  Scopes nest."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            discard(table)
