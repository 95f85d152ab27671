"""What the operators of this subpackage share: cut points, shipping, sizes.

Cut points are Parquet tables below ``spark.checkpoint.dir`` (read from the
session; a folder of our own only where it is unset), so that a lost executor
costs the tasks it ran and not the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    Rows here are whole texts, so batches of the defaults, of 10,000 rows and 64 MB in Arrow and of 4096 rows from Parquet,
    would take much memory: a session that has the defaults gets smaller ones, also for what else it runs.
    """
    for name, default, less in (("execution.arrow.maxRecordsPerBatch", "10000", "500"), ("execution.arrow.maxBytesPerBatch", "67108864b", "4m"), ("parquet.columnarReaderBatchSize", "4096", "500")):
        if spark.conf.get(f"spark.sql.{name}") == default:  # with a default of None, get() gives that for what isn't set
            spark.conf.set(f"spark.sql.{name}", less)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lodestack-ship-")
    target = os.path.join(folder, f"{_ROOT.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(app)


_worker: dict[str, dict] = {}


def give_back() -> None:
    """What this Python worker has freed goes back to the system; allocators keep it otherwise, beside what an executor's
    other processes need."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: A worker gives back what it has freed after so many batches, and when a task ends: pages cost time to get again.
GIVE_BACK = 8


def lean(batches: Iterator) -> Iterator:
    """A task's batches, between which freed memory goes back to the system."""
    for n, b in enumerate(batches, 1):
        yield b
        del b
        if n % GIVE_BACK == 0:
            give_back()
    give_back()


def kept_for(operator: str) -> dict:
    """What a Python worker keeps for an operator from task to task. Workers are used again by other operators: what was
    kept for those is given up then, and freed memory goes back to the system."""
    if operator not in _worker:
        import gc

        _worker.clear()
        gc.collect()
        give_back()
    return _worker.setdefault(operator, {})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = own.get() if own.isDefined() else f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete cut points whose readers are done."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                forget(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back.

    A table that this returned before and that nothing but df still needs can be deleted on the way.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None:
        forget(spark, instead_of._stored_at)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_columns(key: str) -> list[Column]:
    """An integer key for pandas, which would make a column with nulls a float: the key, 0 for null, and whether it is known."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), F.col(key).isNotNull().alias("_known")]


def ids_of(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The keys of id_columns, with their nulls."""
    return pd.arrays.IntegerArray(batch["doc_id"].to_numpy("int64").copy(), ~batch["_known"].to_numpy("bool"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, like these, that no column of df has."""
    taken = " ".join(df.columns).lower()
    lead = "_"
    while any(f"{lead}{n}" in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def text_of(col: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def threshold(share: float) -> int:
    """The 64-bit hash value below which about this share of hashes lies."""
    return min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))


def bounded_sample(df: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows of df, those with the smallest hashes of column ``by``; of rows with the same value the choice is open.

    A first pass counts rows. The hash's threshold then lets about 2 n rows through, so that what is sorted
    doesn't grow with the table or its partitions.
    """
    total = df.count()
    share = min(1.0, 2 * n / max(1, total) + 64 / max(1, total))
    h = F.xxhash64(by)
    low = df.where(h <= F.lit(threshold(share))) if share < 1 else df
    return low.orderBy(h, by).limit(n)
