"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where it is unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "weftlink-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    Used where one expensive intermediate feeds several branches: it is computed once, and a
    lost executor costs only a re-read.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_KEPT: list[tuple[SparkSession, str]] = []
#: Setting by which shuffle files go when the statement ends, not when the driver next collects its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """As :func:`cut` for wide rows: a compressed Parquet table, of which later reads take only the columns they need.

    The table lies in the checkpoint folder and is removed when the program ends. What was shuffled
    for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_kept() -> None:
    for spark, path in _KEPT:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM is gone; the folder's owner clears it
            return


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    For rows on which the next step spends far more time a byte than adaptive execution assumes
    when it joins small partitions into few.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches without the search for cycles, which its many short-lived tuples would set off again and again."""

    def quiet(batches: Iterator) -> Iterator:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return quiet


def release(spark: SparkSession) -> None:
    """Removes the kept tables of finished queries of a session; what still reads them must be over."""
    rest = [x for x in _KEPT if x[0] is not spark]
    mine = [x for x in _KEPT if x[0] is spark]
    _KEPT[:] = mine
    _remove_kept()
    _KEPT[:] = rest
