"""What the operators of this package share: the scratch folder all executors see, and settings for a run."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine, a
    temporary folder is set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as Parquet into a new scratch folder and reads it back: lineage ends there, and every executor can read it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return store(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) that hold within the block only."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session hands texts to Python in batches of at most so many rows, a few MB.

    The setting must hold when a lazy result runs, so it stays; it is never raised.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Hands what this Python worker has freed back to the system: it stays for later stages, next to the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def chosen(hashed: Column, group: Column, counts: dict, sample: int) -> Column:
    """Whether a row's hash is so low that about ``sample`` rows, and a fifth more, of its group's count are chosen."""
    out = F.when(F.lit(False), F.lit(False))
    for value, n in counts.items():
        share = 1.2 * sample / max(n, 1)
        out = out.when(group == value, F.lit(True) if share >= 1 else F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
    return out.otherwise(F.lit(False))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size in bytes (for a scan: the size of its files); 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
