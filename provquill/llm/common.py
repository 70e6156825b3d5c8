"""What the operators of this subpackage share: the shared folder, tables written there, worker-side caches.

Nothing here holds rows on the driver.  Tables that cut lineage go to the folder named by
``spark.checkpoint.dir``; a folder is only made up when that setting is absent (tests, local runs).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: ASCII white space, as the contracts name it.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, so that a run of long texts does not fill a worker.

    The settings are read when a frame runs, after the operator has returned, so they stay; settings that the
    session's owner has made are left alone.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; read from the session, made up only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="provquill-shared-")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    root = f"{configured}/provquill-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_drop, spark, root)
    return root


_roots: dict[str, SparkSession] = {}


def _drop(spark: SparkSession, root: str) -> None:
    """Remove this session's tables when the driver ends, if its JVM still answers."""
    try:
        delete(spark, root)
    except Exception:  # the JVM is gone; the cluster's own clean-up of the folder applies
        return


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whichever file system holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_shared(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write a frame as Parquet in the shared folder; commits are per task, so a lost executor repeats only its own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the written table."""
    path = write_shared(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize gave, once nothing reads them any more."""
    for df in tables:
        if (path := _paths.get(id(df))) is not None:
            delete(df.sparkSession, path)


_paths: dict[int, str] = {}


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that are gone; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """An object kept for the life of a Python worker (a tokenizer, tables of powers), built once per key.

    A worker keeps the last key's object only: stages follow one another, and a vocabulary that the last one
    used would else take memory from the next.
    """
    home = sys.modules.setdefault("_provquill_worker_state", types.ModuleType("_provquill_worker_state"))
    if getattr(home, "key", None) != key:
        home.key, home.value = None, None
        home.value, home.key = make(), key
    return home.value


def forget_worker_state() -> None:
    """Let go of what worker_state keeps; for tasks that need memory and no kept object."""
    home = sys.modules.get("_provquill_worker_state")
    if home is not None:
        home.key, home.value = None, None


def give_back() -> None:
    """Return freed memory to the machine; an idle worker would keep it beside its executor's next stages."""
    forget_worker_state()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: So many keys are sent to every task to drop rows by; more are joined by a shuffle of the rows.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is not among keys (a null key stays); long texts are not shuffled for a few keys."""
    kept = materialize(keys.select(on).distinct(), "dropped-keys")
    few = kept.count() <= BROADCAST_KEYS  # 8 bytes each
    return rows.join(F.broadcast(kept) if few else kept, on, "left_anti")


def routing_keys(spark: SparkSession, per_partition: int) -> list[int]:
    """Whole numbers of which exactly per_partition fall to every shuffle partition, when hashed as a long column.

    A few keys dealt by their hash leave some partitions with several and others with none; these fill all alike.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(n * (20 + 4 * per_partition)).select("id", F.expr(f"pmod(hash(id), {n})").alias("p"))
    found = tried.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("id")), 1, per_partition).alias("ids")).orderBy("p").collect()
    keys = [k for r in found for k in r.ids]
    return keys if len(keys) == n * per_partition else list(range(n * per_partition))


def bare(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of a table, so that further columns can never clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
