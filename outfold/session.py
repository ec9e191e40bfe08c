"""Session setup and the shared folder used for lineage cuts and scratch output."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE turns a shuffle join into a broadcast
# only after it has measured the small side, and splits skewed partitions of a
# sort-merge join; nothing in the library forces a broadcast of data whose size
# grows with the input.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "outfold",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build or reuse a session with the library's defaults.

    ``master`` is only for local runs and tests; on a cluster leave it unset
    and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local runs, tests) is a
    private folder created and registered, so that checkpoints and scratch
    tables never land on a machine-local path on a real cluster.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(HDFS, object store); a machine-local folder cannot hold "
                               "checkpoints on a cluster")
        d = tempfile.mkdtemp(prefix="outfold-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/outfold-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path in the application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables this application wrote to the shared folder while it
    worked; results that still read them must have been stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for local filesystem checks in tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
