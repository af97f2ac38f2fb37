"""Plumbing shared by the training-data operators: scratch tables, code shipping, word patterns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_shipped: "weakref.WeakSet" = weakref.WeakSet()
_left: list = []


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or alphabet."""
    return F.translate(c, _UPPER, _LOWER)


def words_of(c: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WHITE + "+"), lambda w: w != "")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, so that they need no copy of the repository, and bound their batches."""
    # Texts differ in length by orders of magnitude: batches for Python are bounded by bytes, not by rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="codeloom-code-"), "codeloom_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in [root / "__init__.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(at)
    _shipped.add(sc)


_owner: str | None = None
_caches: dict[str, Callable[[], None]] = {}


def caches(owner: str, clear: Callable[[], None]) -> None:
    """Say how to empty what an operator's module keeps in a Python worker."""
    _caches[owner] = clear


def enter(owner: str) -> None:
    """In a Python worker, which lives on between stages: empty what other operators left in it."""
    global _owner
    if _owner != owner:
        _owner = owner
        for k, clear in _caches.items():
            if k != owner:
                clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, as workers wait beside others that need it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def worker(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that finds no caches of other operators in its worker and leaves no freed memory there."""

    def whole(batches: Iterator) -> Iterator:
        from codeloom.llm import common

        common.enter(owner)
        yield from run(batches)
        common.give_back()

    return whole


def forget(spark: SparkSession) -> None:
    """Delete the shuffle files of tables that nothing refers to any more; Spark does so when the driver collects its garbage.

    Twice, as Spark's own listeners refer to a plan until they have heard of its end. Only disk depends on it.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as the cluster names it; our own only on a local master (tests).

    On a cluster that names none this raises: a machine-local folder would be another one on each machine.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return at or "file:///tmp/checkpoints"


#: Bytes up to which a table of known size is broadcast.
BROADCAST = 64 << 20


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` as a side that is broadcast if ``rows`` of at most ``width`` bytes are few enough; else the join is left to Spark."""
    return F.broadcast(df) if rows * width <= BROADCAST else df


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    ``save`` writes Parquet and reads it back. ``drop`` removes a table as soon as no later step
    needs it; what a lazy result still reads stays until ``release_all`` or the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}", 0
        _left.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        at = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._codeloom_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._codeloom_at)

    def release(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release_all(keep: "Scratch | None" = None, since: int = 0) -> None:
    """Delete the scratch tables of results made since ``since`` (see ``now``). Call it when those results are written."""
    for s in [x for x in _left[since:] if x is not keep]:
        _left.remove(s)
        try:
            s.release()
        except Exception:  # noqa: BLE001  at exit the JVM may be gone already; the folder is only scratch
            pass


def now() -> int:
    """A mark for ``release_all``: results made before it keep their scratch tables."""
    return len(_left)


atexit.register(release_all)
