"""Shared folder, staged tables and packed blocks of whole texts for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import ensure_checkpoint_dir

#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows in one block at most; row numbers have room for twice as many.
BLOCK_ROWS = 1 << 13
BLOCK_SCHEMA = "block long, n_rows int, payload binary"
_folders: dict[str, str] = {}
_groups: dict[str, list[str]] = {}
_open: list[str] = []


def _run_folder(spark: SparkSession) -> str:
    """One folder for each application inside the shared checkpoint folder, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{ensure_checkpoint_dir(spark)}/llm-{app}"
        atexit.register(_delete, spark, _folders[app])
    return _folders[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    if _open:
        _groups[_open[-1]].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def grouped(name: str) -> Iterator[None]:
    """Tables staged inside belong to the group ``name`` and live until it is forgotten."""
    _groups.setdefault(name, [])
    _open.append(name)
    try:
        yield
    finally:
        _open.pop()


def forget(spark: SparkSession, name: str) -> None:
    """Delete the tables of a group: everything made from them has been written elsewhere."""
    for path in _groups.pop(name, []):
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more: all that came from it is staged itself."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, parts: int):
    """``crc32`` of the key as text modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def to_payload(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_payload(payload) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def text_slices(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch with a column ``text`` into compact ones of at most ``most`` bytes and ``BLOCK_ROWS`` texts, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_pylist()
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and (held + size > most or row - first == BLOCK_ROWS):
            yield _compact(batch, first, row)
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield _compact(batch, first, len(sizes))


def _compact(batch: pa.RecordBatch, first: int, last: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(first, last - first)]) for c in batch.columns], schema=batch.schema)


def row_values(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The named values of each row, one row at a time, as rows of blocks are large."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(c)[row].as_py() for c in columns)


def numbered_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The slices of all batches of a task, each with a number that no other task gives."""
    partition, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in text_slices(batch):
            yield partition << 32 | serial, part
            serial += 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, part in numbered_slices(batches):
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int64()), "n_rows": pa.array([part.num_rows], pa.int32()), "payload": pa.array([to_payload(part)], pa.binary())})


def pack(docs: DataFrame, name: str, *columns) -> DataFrame:
    """Stage rows as blocks of whole texts, compressed, so that later steps read and move few bytes.

    ``columns`` name what a block holds; one of them must be ``text``. A row's place in its block identifies it, so
    null or repeated ids stay separate rows. Blocks of an empty table: none.
    """
    return stage(docs.select(*columns).mapInArrow(_pack, BLOCK_SCHEMA), name)


def shuffle_width(blocks: DataFrame, bytes_per_task: int = 24 << 20) -> int:
    """Partitions for a shuffle that moves about as many bytes as the packed texts hold uncompressed."""
    count = blocks.count()
    return max(1, -(-count * BLOCK_BYTES // bytes_per_task))
