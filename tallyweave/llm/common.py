"""What the operators share: table reading, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.scratch import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it again: the lineage ends in files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for each frame, once all that was made of it is written too."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Give back what a task's batches took: Python workers go on to other operators' tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a Python worker keeps from task to task, of one operator at a time.
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() returned in an earlier task of this worker, unless another operator's tasks have come between."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """At the start of a task: drop what another operator's tasks have kept in this worker."""
    _KEPT.clear()
    release()


#: ASCII white space as the contracts define it.
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def hash64(*cols: Column) -> Column:
    """xxhash64 in which a null differs from leaving the column out."""
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])
