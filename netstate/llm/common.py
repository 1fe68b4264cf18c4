"""What several operators share: text columns, Arrow batches, shared files."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netstate.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "new_folder", "open_input", "open_output", "per_batch",
           "release_memory", "shuffle_partitions", "small_batches", "text_bytes", "worker_state"]

#: Byte tables for lower-casing A-Z.
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty; bytes that are no UTF-8 pass through."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows; a smaller limit stays.

    Executors and workers hold whole batches: 10,000 texts are tens of megabytes in each.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def per_batch(
    df: DataFrame, schema: str, fn: Callable[[dict[str, list]], Iterable[dict[str, list]]],
    rows: int = 1024,
) -> DataFrame:
    """``mapInArrow`` over plain lists: ``fn`` gets at most ``rows`` rows at a time.

    ``fn`` takes columns as lists and yields columns as lists (or Arrow arrays);
    small slices keep a batch of long texts from being held as objects at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in fn(batch.slice(at, rows).to_pydict()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type) if not isinstance(
                            out[f.name], pa.Array) else out[f.name] for f in target],
                        schema=target)

    return df.mapInArrow(run, schema)


def worker_state(name: str, make: Callable):
    """An object that outlives a task in a Python worker that Spark reuses (a memo)."""
    holder = sys.modules.setdefault("netstate_llm_worker", types.ModuleType("state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def forget_others(name: str) -> None:
    """Drop what other stages keep in this worker, and give its memory back."""
    holder = sys.modules.get("netstate_llm_worker")
    for other in [n for n in vars(holder or types.SimpleNamespace()) if not n.startswith("__")]:
        if other != name:
            delattr(holder, other)
    release_memory()


def release_memory() -> None:
    """Give back what a worker's large objects held: workers outlive the stage."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def new_folder(spark: SparkSession, kind: str) -> str:
    """URI of a fresh folder under ``spark.checkpoint.dir``, which all machines see."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    elif uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream to a new file; folders are made as needed."""
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A file with random access (``size``, ``read_at``, ``seek``, ``read``)."""
    system, path = _filesystem(uri)
    return system.open_input_file(path)
