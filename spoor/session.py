"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions that run in Python workers are pickled by reference to the package, which a worker
    outside the repository cannot import otherwise.
    """
    sc = spark.sparkContext
    if getattr(sc, "_spoor_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._spoor_shipped = True


def shuffled_joins(spark: SparkSession) -> None:
    """Broadcast no table without a hint, neither as planned nor as measured.

    Before a query runs the planner knows file sizes only. Parquet keeps repeated names in a hundredth of
    what they take in memory, and rows made by explode count nothing, so that it would collect gigabytes
    on the driver. Adaptive execution measures rows, but a table of a few of them takes a whole memory page (up
    to 64 MB) on the driver, and a loop over graph levels makes one at every join.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(planned, "-1")
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, "-1")


def local_session(cpus: int | str = "*", app: str = "spoor") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; local masters may fall back to /tmp."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder so that loops keep short plans.

    A reliable checkpoint survives executor loss, unlike a local one.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the checkpoint folder and read it back.

    Unlike a checkpoint the result keeps column pruning, filter pushdown and true sizes, so
    the planner can decide on broadcasts; use it for tables that several queries share.
    """
    path = f"{_checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
