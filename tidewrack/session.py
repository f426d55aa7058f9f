"""Session set-up, table reading, checkpoints and stored tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def make_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes (UTC, AQE with skew handling)."""
    b = (
        SparkSession.builder.master(master)
        .appName("tidewrack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, whatever the driver's own search path; for
    executors that don't see the folder there is ship()."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Without the setting a session on one machine
    gets a temporary folder; on a cluster that is an error, as other machines couldn't read it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        d = "file://" + tempfile.mkdtemp(prefix="tidewrack-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []


def store(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """df written once as a Parquet table, of which each reader reads only the columns it needs. Without
    a path it goes to the shared folder, from which clean() removes it."""
    if path is None:
        path = f"{checkpoint_dir(df.sparkSession)}/tidewrack-{uuid.uuid4().hex}"
        _STORED.append(path)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove the tables that store() wrote to the shared folder; what was built on them is void."""
    jvm = spark.sparkContext._jvm
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scan_splits(df: DataFrame) -> int | None:
    """Splits of the file scan that df only filters and selects from; None for all else. Nothing runs."""
    node = df._jdf.queryExecution().sparkPlan()
    while node.getClass().getSimpleName() in ("ProjectExec", "FilterExec"):
        node = node.children().apply(0)
    return node.inputRDD().getNumPartitions() if node.getClass().getSimpleName() == "FileSourceScanExec" else None


def spread(df: DataFrame) -> DataFrame:
    """df as it is where its scan has at least a split per core, or where it isn't a plain scan; a table
    in fewer files or row groups than that is dealt out to the cores, for the work per row that
    follows. Large tables are never shuffled by this, and no job is started."""
    importable(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = scan_splits(df)
    return df.repartition(cores) if splits is not None and splits < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it isn't installed."""
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="tidewrack-pkg-"), "tidewrack.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in root.rglob("*.py"):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(out)
