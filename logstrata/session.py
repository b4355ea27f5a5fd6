"""Session factory and the helpers that every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def get_spark(app: str = "logstrata", cpus: str | int | None = None) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use the cluster's own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.driver.memory", os.environ.get("LOGSTRATA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_logstrata_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="logstrata-")) / "logstrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._logstrata_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the cluster's spark.checkpoint.dir, which all executors share.

    Only where the setting is missing and all tasks run on this machine, as in tests, a temporary folder takes its
    place; on a cluster a missing setting is an error, as executors would write to folders of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="logstrata-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and go on from there, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """Like cut(), as a compressed table whose `path` can be read elsewhere too; `by` are the columns of its folders."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def read_part(path: str, column: str, value: int):  # noqa: ANN201
    """In a task: the rows of one folder of a table of written(), as an Arrow table, or None if there is no such folder."""
    from pyarrow import dataset, fs

    system, root = (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
    folder = f"{root}/{column}={value}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    return dataset.dataset(folder, filesystem=system, format="parquet").to_table()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if a count proves that it has at most `rows` rows; else leave the join to the optimiser."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, as a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, megabytes: int = 32) -> None:
    """Limit Arrow batches by size, not only by rows, so that very long texts don't pile up in a Python worker.

    A limit that the session already has stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(megabytes << 20))
