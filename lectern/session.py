"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lectern", cpus: int | None = None, checkpoints: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches with its folder for checkpoints; on a cluster the caller brings its own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.dir": checkpoints or os.path.join(tempfile.gettempdir(), f"lectern-{os.getpid()}"),  # one machine
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: where the context already keeps checkpoints, else the one of spark.checkpoint.dir."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="lectern-")  # one machine
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def spread(df: DataFrame) -> DataFrame:
    """Rows of few partitions over all cores before heavy work; tables with a partition for each core at least stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that is read more than once, in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, wherever they run; once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
