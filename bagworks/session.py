"""Session settings and the two ways in which a plan's lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "bagworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume (UTC, adaptive execution with skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of its own where that is unset and the master is local;
    a cluster without that setting is an error, as a folder of the driver's machine isn't shared."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="bagworks-")
        sc.setCheckpointDir(there)
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner clears it
        pass


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark context, so their Python needs no path of its own to it.

    The archive lies in the shared folder for as long as the driver runs: executors that come later fetch it too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_bagworks_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = f"bagworks-{uuid.uuid4().hex[:8]}.zip"
    target = f"{shared_dir(spark).rstrip('/')}/bagworks-code/{name}"
    with tempfile.TemporaryDirectory(prefix="bagworks-code-") as tmp:
        with zipfile.ZipFile(os.path.join(tmp, name), "w") as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        jvm = sc._jvm
        to = jvm.org.apache.hadoop.fs.Path(target)
        to.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(os.path.join(tmp, name)), to)
    sc.addPyFile(target)
    sc._bagworks_shipped = True
    atexit.register(_drop, spark, target)


_TABLES: list[str] = []


def drop_tables(spark: SparkSession) -> None:
    """Drops all tables that `materialize` wrote in this driver. Frames that read them can't be used any more."""
    while _TABLES:
        _drop(spark, _TABLES.pop())


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, dropped when the driver ends or by `drop_tables`."""
    path = f"{shared_dir(spark).rstrip('/')}/bagworks-tables/{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(drop_tables, spark)
    _TABLES.append(path)
    return path


def materialize(df: DataFrame, *, sort: Iterable[str] = ()) -> DataFrame:
    """df, written once as a table in the shared folder and read back.

    It outlives lost executors, is read column by column and knows its row count from the footers. The table is dropped when the
    driver ends, or by `drop_tables`.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    sort = list(sort)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is, for a shuffled join.

    df should be cheap to count: a materialized table or a small input.
    """
    n = len(df.select(F.lit(1)).limit(max_rows + 1).collect()) if max_rows < 1000 else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        out.append(c)
    return out
