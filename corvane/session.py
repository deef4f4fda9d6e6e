"""Session helpers: defaults, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that every local session of this library starts with; a cluster sets its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    app: str = "corvane", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in tests on one
    machine, a temporary folder is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


def bounded_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is.

    The size is measured, not assumed: one job reads at most ``max_rows + 1`` rows. Past the bound
    the plan is left to Spark, which then joins by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def without_and_with(df: DataFrame, keys: DataFrame, key: str, max_rows: int = 200_000) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df`` whose key is none of ``keys``, and the others; null where there are none.

    Nothing of ``df`` is moved while there are at most ``max_rows`` keys: these are read once and sent
    to all tasks. More are left to Spark, as in ``bounded_broadcast``.
    """
    keys = keys.select(F.col(key).alias("__key"))
    rows = keys.limit(max_rows + 1).collect()
    if not rows:
        return df, None
    if len(rows) <= max_rows:
        keys = F.broadcast(df.sparkSession.createDataFrame(rows, keys.schema))
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over as many partitions as there are cores.

    A small file is read by one task or two; work on each row that takes long would leave the other
    cores idle. A scan that has a task for every core already, as any large one, stays as it is, so
    that no text of it is moved, and so does what is no plain scan.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # it shuffles already; asking for its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows_at_most(df: DataFrame, max_rows: int, what: str) -> list:
    """The rows of a table that is small by definition; raises if it is larger than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; pass it in blocks")
    return rows


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python functions find it there.

    On a cluster the library need not be installed on every machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corvane-pkg-"), "corvane.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._corvane_shipped = True
