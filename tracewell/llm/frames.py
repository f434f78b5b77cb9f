"""Small DataFrame helpers of the text operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels
from tracewell.sources.shared import drop_folder, new_folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, re.sub(r"[^A-Za-z0-9_]", "_", name))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the folder that `cut` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop_folder(df.sparkSession, files[0].rpartition("/")[0])


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of an Arrow batch: texts are long, and a batch is held by the executor and its Python worker alike.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus.  Where the session has no size of Arrow batches of its own, BATCH_ROWS is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, by Arrow: from a plain list Spark would start a second set of Python workers."""
    fields = T.StructType.fromDDL(schema).fields
    made = spark.createDataFrame(pa.table(list(map(pa.array, zip(*rows, strict=True))), names=[f.name for f in fields]))
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """At the end of a task: a worker waits for later tasks and stages, so what it no longer uses goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def map_text(
    df: DataFrame,
    text: str,
    setup: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    limit: int = kernels.CHUNK_BYTES,
) -> DataFrame:
    """Add columns computed from a text column, in Arrow batches.

    `setup` runs once per task and gives a function from a slice of texts
    (about `limit` bytes; a longer text is a slice alone) to one array for each
    of `fields`.  The columns in `keep` (default: all) stay; a kept column that
    has the name of a new one is replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[col(c) for c in kept], col(text).alias("__text"))
    schema = T.StructType([*(source.schema[i] for i in range(len(kept))), *fields])

    def run(batches):
        work = setup()
        for batch in batches:
            texts = batch.column(len(kept))
            for first, n in kernels.slices(texts, limit):
                part = batch.slice(first, n)
                made = work(texts.slice(first, n))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [f.name for f in schema])
                del part, made
            del batch, texts
        del work
        give_back()

    return source.mapInArrow(run, schema)
