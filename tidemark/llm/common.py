"""What the operators share: reading, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of Python handles; bounds memory whatever the Arrow batch is.
SLICE_ROWS = 512
#: Rows of a document table that go to Python at once, unless the session says otherwise.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does once the driver's JVM has collected their plans."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that stash made, once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what stash and the file writers left in the shared folder; results not yet read are lost."""
    _delete(spark, f"{scratch(spark)}/tidemark")


def by_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of batch of SLICE_ROWS rows."""
    return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


#: What empties the caches that a Python worker keeps between tasks.
_kept: list[Callable[[], None]] = []
_work = ""


def kept(clear: Callable[[], None]) -> None:
    """Names a function that empties a cache of this process."""
    _kept.append(clear)


def turn_to(work: str) -> None:
    """Empties the caches of this process if they were filled for other work; between tasks of the same work they stay."""
    global _work
    if work != _work:
        for clear in _kept:
            clear()
        gc.collect()
        give_back()
        _work = work


def give_back() -> None:
    """Returns memory to the system that Arrow and the C library hold but no object uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, work: str = "") -> DataFrame:
    """mapInArrow by a worker that drops the caches of other work (by default: of other modules) first, and gives unused memory back at the end.

    Spark keeps Python workers for later tasks, of any stage: what one held would add to what the next needs.
    """
    work = work or run.__module__

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(work)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, cut: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]] = by_rows) -> DataFrame:
    """map_batches over small slices, as cut gives them; make() is called once per task and gives the function of a slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for some in cut(batch):
                out = step(some)
                if out is not None and out.num_rows:
                    yield out

    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return map_batches(df, run, schema, make.__module__)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose strings in column hold up to `most` bytes together; a longer string is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def places(rows: DataFrame, keys: list[Column | str], name: str) -> tuple[DataFrame, int]:
    """rows with column `name`: their place, from 0, in the order of keys; and how many rows there are.

    Rows alike in all keys stay together in one sort task and take places as they come.
    One range shuffle, kept in the shared folder so that places are drawn once; one count
    for each of its partitions goes to the driver.
    """
    spark = rows.sparkSession
    at, part, before = (fresh(rows.columns, x) for x in ("_at", "_part", "_before"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn(part, F.shiftright(at, 33))
    starts, total = [], 0
    for p, count in sorted(tuple(r) for r in dealt.groupBy(part).count().collect()):
        starts.append((p, total))
        total += count
    # One row for each partition: small enough to broadcast.
    offsets = spark.createDataFrame(starts, f"{part} long, {before} long")
    row = F.col(at).bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + row).drop(at, part, before), total


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def bucket_of(doc_id: int | None, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or with underscores after it as far as columns has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
