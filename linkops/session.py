"""Session settings, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "linkops", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on (UTC clock, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, wherever the driver was started.

    Workers of this machine get the folder; a cluster needs the package installed, or its wheel or zip added with
    ``spark.sparkContext.addPyFile``.
    """
    home = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if home not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, held) if p)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of its own; on a cluster an unset folder is
    an error, because executors could not read a machine-local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="linkops-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table survives lost executors, keeps column pruning, and pins values such as
    ``monotonically_increasing_id`` that must not be computed twice.
    """
    path = scratch_path(df.sparkSession, label)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Folders staged inside each open ``staging`` block, innermost last.
_OPEN: list[list[str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def staging(spark: SparkSession):
    """Tables materialized inside the block are deleted when it ends; frames over them are of no use afterwards."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_path(spark, path)


def staged(fn):
    """Store the frame that ``fn`` returns and delete whatever else it staged. The first argument of ``fn`` is a frame
    or the session."""

    @functools.wraps(fn)
    def run(first, *args, **kwargs) -> DataFrame:
        spark = first.sparkSession if isinstance(first, DataFrame) else first
        with staging(spark):
            out = fn(first, *args, **kwargs)
            path = scratch_path(spark, fn.__name__)
            out.write.parquet(path)
        if _OPEN:
            _OPEN[-1].append(path)
        return spark.read.schema(out.schema).parquet(path)

    return run


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: eight for each plain value, and the contents of strings, binaries and arrays."""

    def width(value: Column, kind) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StringType):
                return F.lit(16) + F.coalesce(F.octet_length(F.array_join(value, "")) + 16 * F.size(value), F.lit(0))
            each = 8 * (len(inner.fields) + 1) if isinstance(inner, T.StructType) else 8
            return F.lit(16) + F.greatest(F.size(value), F.lit(0)) * F.lit(each)
        return F.lit(8)

    total = F.lit(0).cast("bigint")
    for field in df.schema:
        total = total + width(F.col(f"`{field.name}`"), field.dataType)
    return total


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for ``df`` only after one aggregate shows that its rows and their bytes are few; else leave the
    join to Catalyst. Meant for stored tables, since ``df`` is read for the check."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row work on an input with fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
