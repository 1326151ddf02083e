"""Helpers shared by the training-data operators: shared storage, inputs, Arrow columns, joins on hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that ``[\x20\x09-\x0D]`` stands for.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_own_shared: dict[str, str] = {}


#: Paths made within each open scratch(), innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master, where it may be unset (tests), a temporary folder of this process is taken.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_shared:
        _own_shared[app] = "file://" + tempfile.mkdtemp(prefix="siftlake-")
    return _own_shared[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all intermediate tables made within; what is computed from them must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that go to a Python worker at once. Texts are large, and a batch lies in memory on both sides.
ROWS_AT_ONCE = 500


def small_batches(spark: SparkSession) -> None:
    """Bound what a batch of texts takes: Spark's own default of 10,000 rows is for narrow ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_null(col: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeezed(text: Column) -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, ASCII_SPACE, "")


def bytes_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def text_list(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def sliced(batches, column: str, most: int = 4 << 20):
    """The same rows in slices of about ``most`` bytes of a text column, at least one row each."""
    for batch in batches:
        size = max(1, batch[column].nbytes)
        rows = max(1, int(batch.num_rows * most / size))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker's peak else stays with it for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_worker: dict[tuple, object] = {}


def worker_state(key: tuple, make=lambda: None):
    """What an operator keeps in a Python worker from task to task.

    A worker keeps one operator's state at a time; operators that keep none call this too, with a key alone, and so free
    what the operator before has left.
    """
    if key not in _worker:
        if _worker:
            _worker.clear()
            give_back()
        _worker[key] = make()
    return _worker[key]


#: Rows of one key that one task joins at most, unless that made more than MOST_HOT keys hot.
HOT_ROWS, MOST_HOT = 50_000, 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, pieces) of the keys that have more rows than one task should join; at most MOST_HOT of them."""
    most = max(HOT_ROWS, -(-rows.count() // MOST_HOT))
    return rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("pieces"))


def split_join(rows: DataFrame, few: DataFrame, key: str, spread: Column, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key, on ``key``: the rows of hot keys are cut by a hash of
    ``spread`` into pieces, each of which gets a copy of the key's row in ``few``. ``hot``: rows of hot_keys(), if known."""
    hot = hot_keys(rows, key).collect() if hot is None else hot  # at most MOST_HOT
    if not hot:
        return rows.join(few, key, how)
    kind = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == key)
    table_of = F.broadcast(rows.sparkSession.createDataFrame([tuple(h) for h in hot], f"`{key}` {kind}, __pieces int"))
    left = rows.join(table_of, key, "left").withColumn("__piece", F.pmod(F.xxhash64(spread), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    right = few.join(table_of, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return left.join(right, [key, "__piece"], how).drop("__piece")
