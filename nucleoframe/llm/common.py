"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+.
SPACE = "\\x20\\x09-\\x0D"


#: Bytes of a batch that goes to a worker or comes from it, and the session's setting for the former.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, converted one row at a time so that a
    batch of long texts isn't held a second time as Python objects."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


#: What drops the store that the worker's tasks have made last, if they keep one.
_drop_store: Callable[[], None] | None = None


def in_worker(run: Callable, batches: Iterator[pa.RecordBatch], drop_store: Callable[[], None] | None) -> Iterator[pa.RecordBatch]:
    """run(batches) in a worker. Workers live on for the tasks of later stages, so the store of
    another operator is dropped first, and what Arrow holds unused is given back after each batch."""
    global _drop_store
    if _drop_store is not None and _drop_store is not drop_store:
        _drop_store()
    _drop_store = drop_store
    pool = pa.default_memory_pool()
    try:
        for batch in run(batches):
            yield batch
            del batch
            pool.release_unused()
    finally:
        pool.release_unused()


def map_batches(df: DataFrame, run: Callable, schema, drop_store: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) with a bounded memory in the workers and beside the heap of
    their executor: batches have about BATCH_BYTES, whatever the lengths of texts, unless the session
    sets BATCH_SETTING itself. `drop_store`, a function of a module, drops what run keeps in a
    worker from task to task."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def held(batches):
        return in_worker(run, batches, drop_store)

    return df.mapInArrow(held, schema)


class Sink:
    """Collects output rows and hands them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 20_000, most_bytes: int = 16 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, *values, weight: int = 0) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += weight

    def full(self) -> bool:
        return len(self.columns[0]) >= self.most or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema
        )
        self.clear()
        return batch


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: this cuts
    the lineage, and the copy survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of written copies that are deleted together, once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_path(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column begins with it (letter case aside)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def fold(id_column: str, parts: int):
    """crc32 of the id as text, modulo parts: the folds of the labelled rows (-1: no id)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts, F.lit(-1))
