"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension of up to so many rows is broadcast; a larger one is dealt out.
SMALL_ROWS, SALTS = 100_000, 32


_made: list[str] = []  # folders given out by this driver


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on one machine only, a folder beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


class Scratch:
    """The folders of tables between jobs since it was made."""

    def __init__(self, spark: SparkSession):
        self._spark, self._from, self._kept = spark, len(_made), set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Spare the folder that `df` reads."""
        self._kept |= {f.rpartition("/")[0].split(":")[-1].lstrip("/") for f in df.inputFiles()}
        return df

    def clear(self) -> None:
        for path in _made[self._from :]:
            if path.split(":")[-1].lstrip("/") not in self._kept:
                drop_folder(self._spark, path)
                _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Inside, results are made and written; at the end all tables between jobs that this took are deleted."""
    held = Scratch(spark)
    try:
        yield held
    finally:
        held.clear()


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_of(df: DataFrame) -> str:
    """The folder of the files that `df` reads."""
    return df.inputFiles()[0].rpartition("/")[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet and read it back: its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_dimension(df: DataFrame, dimension: DataFrame, key: str, own: str, how: str = "left") -> DataFrame:
    """`df` joined with a dimension (its key column named `own`) on `key`.

    A dimension of at most SMALL_ROWS rows is broadcast.  Of a larger one each row is copied to SALTS
    parts of its key, over which the rows of `df` are spread by their content: a busy key is no hot task.
    """
    same = F.col(key) == F.col(own)
    if dimension.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return df.join(F.broadcast(dimension), same, how)
    salted = dimension.withColumn("_own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted, same & (F.col("_salt") == F.col("_own_salt")), how).drop("_salt", "_own_salt")
