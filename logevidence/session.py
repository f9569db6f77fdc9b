"""Session defaults and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "logevidence", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session-level options the operators rely on (safe to repeat).

    Timestamps are read and printed in UTC, and a JSON payload that repeats a key
    keeps the last value instead of being rejected.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster; only a local session (tests, a laptop) may
    leave it unset, and gets a temporary folder, recorded in the session. Elsewhere that is an
    error: executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("logevidence.staging.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="logevidence-")
        spark.conf.set("logevidence.staging.dir", root)
    return root.rstrip("/")


def staging_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{staging_root(spark)}/logevidence/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Runs one job. Used where a plan needs a small intermediate result several times:
    lineage is cut (a lost executor does not redo the work before it), and because the
    result has a known file size the optimizer itself decides whether it may be broadcast.
    """
    spark = df.sparkSession
    path = staging_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads, once nothing will read it again; other tables are left alone."""
    spark, root = df.sparkSession, f"{staging_root(df.sparkSession)}/logevidence/stage-"
    plain = lambda path: path.split(":", 1)[-1].replace("///", "/", 1)  # noqa: E731  (file:/a, file:///a and /a are one)
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if plain(folder).startswith(plain(root)):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
