"""Session settings that the engine's plans are written for."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import uuid
import weakref
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Settings to apply when building a session; a cluster sets sizes of its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def build(app: str = "prismal", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable in Python workers, once per SparkContext; without an argument for the active session."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    out = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}_code.zip")
    with open(out, "wb") as fh:
        fh.write(buf.getvalue())
    spark.sparkContext.addPyFile(out)
    _shipped.add(spark.sparkContext)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back, for tables that are read many times: a lost executor costs a re-read.

    Where the setting is missing, a local folder serves, in local mode only.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "prismal-shared")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
