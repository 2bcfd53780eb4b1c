"""What several operators share: scratch tables, folds, and bytes of texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a class for Java's expressions.
SPACE = r"\x20\x09-\x0D"
#: The scratch folders of this process, for ``clear``.
FOLDERS: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared folder that the cluster names.

    Only where no ``spark.checkpoint.dir`` is set and Spark runs in one process (tests) a folder
    below the system's temporary one takes its place; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    FOLDERS.append(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Let Arrow batches have ``rows`` rows at most while a table is written: workers hold a few copies of a batch. The setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` as a table in ``path``: it cuts lineage and outlives executors."""
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch folders of this process. Results that were not written yet can't be read any more."""
    while FOLDERS:
        drop(spark, FOLDERS.pop())


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key's text modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def share(key: Column, salt: str = "sample") -> Column:
    """A number in [0, 1) that depends on the key's text alone."""
    return (F.xxhash64(key.cast("string"), F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """The column in parts of some ``most`` bytes, one value at least: a batch may hold many or long texts, and Python a few copies of each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null counts as empty."""
    for part in slices(texts):
        for x in part.cast(pa.binary()).to_pylist():
            yield x or b""


def as_strings(texts: pa.Array) -> Iterator[str]:
    """Each text; null counts as empty."""
    for part in slices(texts):
        for x in part.to_pylist():
            yield x or ""


def _settled(plan) -> bool:
    """Whether a plan gives the same rows in the same places each time: files, and what is worked out row by row from them."""
    name = plan.nodeName()
    if name == "LogicalRelation":
        return plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    below = plan.children()
    return name in ("LocalRelation", "Project") and plan.deterministic() and all(_settled(below.apply(i)) for i in range(below.size()))


def settled(df: DataFrame, path: str) -> DataFrame:
    """``df``, or a written copy of it if it may give its rows in other places next time: a row's place can be its number then."""
    return df if _settled(df._jdf.queryExecution().optimizedPlan()) else written(df, path)


def whole(docs: DataFrame) -> Column:
    """All columns, whatever their names, as struct ``row``."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def keyed(docs: DataFrame, path: str) -> DataFrame:
    """(row_id, row): each row whole, under a number of its own.

    Decisions are made on the number, so columns of any name and repeated ids do no harm.
    """
    rows = settled(docs, path)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), whole(rows))
