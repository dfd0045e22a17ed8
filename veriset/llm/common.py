"""Shared helpers: reading tables, shared-folder tables, worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java or Python character class.
WS = r"[\x20\x09-\x0D]+"
#: Session setting by which a query's shuffle files are deleted as soon as it is over.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def by_value(module_name: str) -> None:
    """Ship a module's functions to Python workers by value, so that workers need no path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_veriset_dir", None) or "file://" + tempfile.mkdtemp(prefix="veriset-")
        spark.sparkContext._veriset_dir = found
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared folder."""
    return f"{shared_dir(spark)}/veriset/{spark.sparkContext.applicationId}"


def cut(spark: SparkSession, df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there.

    The shuffle files of the write go with its end: no other query reads them, and Spark's own collection keeps those of the last query.
    """
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.veriset_path = path
    return found


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again, and let Spark drop the shuffle files of queries that are over.

    Spark drops them when its driver collects the objects that stand for them, which may be long after.
    """
    for t in tables:
        _delete(spark, t.veriset_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must have been written."""
    _delete(spark, work_dir(spark))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a mapInArrow, in a worker that drops the caches of other steps before and gives free memory back after.

    Spark keeps idle workers for a minute and uses them again; what they hold counts to their executor while it does other work.
    """

    def alone(batches):
        sys.modules.pop("_veriset_worker_cache", None)
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return alone


def _give_back() -> None:
    """Return the freed memory of this process to the system, which the C library keeps for itself otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # without glibc there is no such call
        ctypes.CDLL(None).malloc_trim(0)


def from_one_task(rows: DataFrame, fit: Callable[[list[dict]], dict | None]) -> dict | None:
    """What ``fit`` makes of all ``rows``, computed in one task, so that the driver never holds the rows.

    ``rows`` must be bounded. The result, a dict of plain values and arrays, comes back pickled.
    """

    def run(batches):
        found = [r for b in batches for r in b.to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def worker_cache(name: str) -> dict:
    """A dict that outlives a task in a reused Python worker."""
    module = sys.modules.setdefault("_veriset_worker_cache", types.ModuleType("_veriset_worker_cache"))
    return module.__dict__.setdefault(name, {})


def text_of(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
