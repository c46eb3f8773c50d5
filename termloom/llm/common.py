"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.runtime import delete, ship_package, work_path

ARROW_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}

Schema = Sequence[tuple[str, str]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; the shuffle files of its plan, of no use afterwards, are deleted when it has been written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


#: Where the frames that cut() has given are, while they are alive.
PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and continue from the files.

    Unlike an eager checkpoint() it computes its input once, is compressed, and gives the
    optimizer true sizes. The files stay until clear_work(), or until discard() where
    nothing reads them any more.
    """
    spark = df.sparkSession
    path = work_path(spark)
    write(df, path)
    found = spark.read.schema(df.schema).parquet(path)
    PATHS[found] = path
    return found


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of frames that cut() has given, when no frame that is still in use reads them."""
    for frame in frames:
        if frame is not None and frame in PATHS:
            delete(frame.sparkSession, PATHS.pop(frame))


#: Rows of an Arrow batch where the session has Spark's default of 10,000: long texts make those large on both sides.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Ship the package, and bound the batches that go to Python workers unless the session has set its own bound."""
    ship_package(spark)
    if spark.conf.get(BATCHES) == DEFAULT_ROWS:
        spark.conf.set(BATCHES, BATCH_ROWS)


def ddl(schema: Schema) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: Schema, rows: int = 256) -> DataFrame:
    """Run a block function over df's columns with Arrow transfer.

    ``make()`` is called once per task and returns ``block(columns) -> columns``; a
    block has at most ``rows`` rows, so that memory is bounded by a few texts.
    """
    kinds = [ARROW_TYPES[kind] for _, kind in schema]
    names = [name for name, _ in schema]

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_to(owner)
        block = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = block([column.to_pylist() for column in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(found, kinds, strict=True)], names=names)

    ready(df.sparkSession)
    return df.mapInArrow(run, ddl(schema))


#: What a worker keeps from task to task (vocabularies, caches, tables): that of one operator at a time.
RESIDENT: dict[str, dict] = {}
#: Whose work this worker did last.
LAST = ""


def leave_to(owner: str) -> None:
    """Forget what other operators keep in this worker and give its memory back, so that a pipeline's stages do not add up."""
    global LAST
    if owner == LAST:
        return
    LAST = owner
    for other in [o for o in RESIDENT if o != owner]:
        del RESIDENT[other]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def resident(owner: str, key, build: Callable):
    """The object of an operator under a key, built once per worker; a new key replaces the old one."""
    own = RESIDENT.setdefault(owner, {})
    if key not in own:
        own.clear()
        own[key] = build()
    return own[key]


class Recent(dict):
    """A cache of two generations: full, it becomes the old one, whose entries return when used.

    Holds at most twice ``limit`` entries; a miss calls ``make``.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        return value


def documents(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
