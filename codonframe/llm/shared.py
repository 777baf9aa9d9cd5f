"""Shared folder and table helpers for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Without the
    setting a local session takes a temporary folder; a cluster has no other
    folder that all its machines see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if (here := _round.get()) is not None:
        here.paths.append(path)
    return path


class Round:
    """The tables written since it began. ``keep`` spares the one written last."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(self.paths.pop())
        return df


_round: ContextVar[Round | None] = ContextVar("round", default=None)


@contextmanager
def only_kept(spark: SparkSession):
    """Deletes at its end, unless it ends in an error, what is written inside to the shared folder and not kept.

    For steps whose outcome is a written table: whatever it was made of is of no use then.
    """
    token = _round.set(Round())
    here = _round.get()
    try:
        yield here
    except BaseException:
        here.kept, here.paths = here.kept + here.paths, []
        raise
    finally:
        _round.reset(token)
        discard(spark, here.paths)
        if (outer := _round.get()) is not None:
            outer.paths.extend(here.kept)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go as soon as it has ended. For chains of tables that are written, read and not made again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(column: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; false for null ids."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def whole_ids(df: DataFrame, column: str) -> None:
    """An error unless the ids are whole numbers, which the operators that compare documents order and join by."""
    kind = df.select(column).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")
