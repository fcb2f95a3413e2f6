"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and bench.py use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches: the cluster's ``spark.checkpoint.dir``.

    Only on one machine, where that setting is missing, a temporary folder stands in; elsewhere its
    absence is an error, as a machine-local folder would lose or hide files.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lexforge-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder. Reliable checkpoints survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast by an estimate.

    Estimates don't know how many rows come out of ``explode`` or of a Python function, so a side
    that stems from one is joined by shuffle; adaptive execution still splits its skewed partitions.
    """
    return df.hint("merge")


def first_rows(ordered: DataFrame, n: int) -> list:
    """The first ``n`` rows of an ordered DataFrame. The partitions' own first rows meet in one task; only ``n`` rows reach the driver."""
    return cut(ordered.limit(n)).collect()


def hashed_sample(rows: DataFrame, total: int, n: int, *keys: str) -> list:
    """``n`` of the ``total`` rows, those of the lowest hash of ``keys``, all rows if there are no more.

    Rows are left out by their hash in the scan, so about ``1.3 * n`` move however many there are.
    """
    from pyspark.sql import functions as F

    h = F.xxhash64(*keys)
    if total > 2 * n:
        share = min(1.0, 1.3 * n / total + 40 / total)
        rows = rows.where(F.shiftrightunsigned(h, 1) <= int(share * ((1 << 63) - 1024)))
    return first_rows(rows.orderBy(h, *keys), n)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, computed once, with a broadcast hint if it has at most ``most`` rows; larger it is joined by shuffle."""
    from pyspark.sql import functions as F

    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else by_shuffle(kept)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """The rows of a scan over all cores where its files give fewer splits than there are cores.

    For work that costs far more than moving the rows. Larger inputs have enough splits and stay.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_lexforge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexforge-")) / "lexforge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._lexforge_shipped = True
