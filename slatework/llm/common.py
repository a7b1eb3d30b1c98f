"""Helpers shared by the training-data operators: inputs, shared storage, Arrow batch limits."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager
from typing import Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker: whole texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session, so that long texts don't add up in a worker.

    The settings are only ever lowered, and stay: the plans that operators return run after the operator has returned.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, where they are one process, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slatework-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders written by materialize() and not yet removed. Paths only: a DataFrame kept here would keep its plan and file
#: listing in the driver's JVM.
_WRITTEN: dict[str, None] = {}


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet under the shared folder and read it back. discard(), the end of a scratch() block
    or the end of the JVM removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._slatework_path = path
    _WRITTEN[path] = None
    return out


def _remove(spark: SparkSession, path: str) -> None:
    if _WRITTEN.pop(path, 0) is None:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(jpath, True)
        files.cancelDeleteOnExit(jpath)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_slatework_path", None)
    if path:
        _remove(spark, path)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark removes the shuffle files and broadcasts of finished plans only once the JVM has
    collected them, and until then both stay; a step of many small jobs calls this on its way."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """At the end of the block everything that was materialized inside goes, but for what is in the list that it gives.

    A returned plan still reads its intermediate tables, so write it inside the block:
    `with scratch(spark): search(df, ...).write.parquet(path)`.
    """
    before, kept = set(_WRITTEN), list(keep)
    try:
        yield kept
    finally:
        spared = before | {getattr(x, "_slatework_path", None) for x in kept}
        for path in [x for x in _WRITTEN if x not in spared]:
            _remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def most_frequent(rows: DataFrame, group: str, key: str, n: str, most: int) -> DataFrame:
    """Of each group's rows about `most` by falling n: whole steps of n, and of the step that doesn't fit a share by the
    hash of the key. Groups must be few; the driver gets their steps, 16 for each doubling of n."""
    step = F.floor(F.log2(n) * 16).cast("int")
    sizes: dict[str, list[tuple[int, int]]] = {}
    for name, s, c in rows.groupBy(group, step.alias("s")).count().collect():
        sizes.setdefault(name, []).append((s, c))
    bounds = []
    for name, found in sizes.items():
        room = most
        for s, c in sorted(found, reverse=True):
            if c > room:
                bounds.append((name, s, int((1 << 20) * room / c)))
                break
            room -= c
    if not bounds:
        return rows
    limits = rows.sparkSession.createDataFrame(bounds, "_group string, _step int, _part long")
    met = rows.join(F.broadcast(limits), F.col(group) == F.col("_group"), "left")  # a row for each group at most
    some = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.col("_part")
    return met.filter(F.col("_group").isNull() | (step > F.col("_step")) | ((step == F.col("_step")) & some)).select(*rows.columns)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, equals remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_BUILT: dict = {}


def trim() -> None:
    """Give what this worker has freed back to the system: Python's objects, Arrow's pool, the C library's heap."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: large arrays aren't kept when they are freed
        libc.malloc_trim(0)


def per_process(key, build):
    """The object of this key, built once in a Python worker, which serves many tasks. Only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        trim()
        _BUILT[key] = build()
    return _BUILT[key]
