"""Session-level helpers: reading tables, cutting lineage, and broadcasting behind a size check."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, if they would not find it by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.abspath(p) == root for p in known) or getattr(spark.sparkContext, "_pagemill_sent", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="pagemill-"), "pagemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(os.path.join(root, "pagemill")):
            for name in sorted(files):
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._pagemill_sent = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the folder that the session names in ``spark.checkpoint.dir`` (or that was set on the context). Only a local
    session without such a setting, as in tests, gets a temporary one; a cluster without it is refused.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends there, and it survives lost executors.

    The folder is removed by ``forget``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def forget(spark: SparkSession) -> int:
    """Removes the intermediate tables written so far and says how many: for a driver that runs query after query, once a result is written."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)
    gone = len(_written)
    _written.clear()
    return gone


#: Most bytes of a table that is broadcast, whatever its rows.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``max_rows`` rows of ``max_bytes`` together; reads no more than that many rows."""

    def width(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 8
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 8
        return F.lit(8)

    total = sum((width(f"`{n}`", k) for n, k in df.dtypes), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes prove it small, else unchanged, so that the join shuffles."""
    return F.broadcast(df) if small(df, max_rows, max_bytes) else df
