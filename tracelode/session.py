"""Session set-up and the few things every operator needs from a session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Configuration the engine is tuned for.  A session handed in by a caller is
#: never reconfigured; operators only rely on what they state themselves.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "tracelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in
    ``spark.checkpoint.dir``.  Only where that is unset and all tasks run on this
    machine (tests) a temporary folder is made and remembered in the session;
    on a cluster each executor would write to a disk of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracelode.shared.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.tracelode.shared.dir", d)
    return d.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def sweep() -> None:
    """Deletes the tables that :func:`cut` wrote; results that still read them become unusable.

    Runs by itself when the driver's Python ends; long-lived sessions may call it between queries."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone, and its folder with it
            return


atexit.register(sweep)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, swept like the tables of :func:`cut`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that several later stages read the result once
    computed; the files outlive lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(c: Column, t: T.DataType) -> Column:
    """About what a value takes in a broadcast table."""
    if isinstance(t, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes(c[f.name], f.dataType) for f in t.fields], F.lit(8))
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return 24 + 8 * F.coalesce(F.size(c), F.lit(0))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return 24 + 2 * F.coalesce(F.length(F.to_json(c)), F.lit(0))
    if isinstance(t, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32_000_000) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, by one aggregate over it."""
    width = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32_000_000) -> DataFrame:
    """``df`` with a broadcast hint only if it provably fits; beyond that the frame
    comes back without a hint and joins by shuffle."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def parallelism(spark: SparkSession, per_core: int = 2) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def here(*parts: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), *parts)
