"""Shared plumbing of the training-data operators: Arrow blocks and checkpoints."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled by one vectorised step of a Python worker.
BLOCK_BYTES = 1 << 20


class Bytes:
    """Texts of one block as a single byte buffer: text i is data[start[i]:start[i + 1]]."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        first = int(offsets[0]) if len(offsets) else 0
        self.data = data[first : int(offsets[-1])] if len(column) else data[:0]
        self.start = (offsets - first) if len(column) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        place = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def reuse_memory() -> None:
    """Let this worker use freed arrays of up to 4 MB again rather than return them to the system each time."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


#: Rows for which a checkpoint of known size gets one file.
FILE_ROWS = 1 << 15


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    About how many ``rows`` there are, if known, bounds its files: for each one a local
    file system starts two processes (chmod) from the executor. The folder is the session's spark.checkpoint.dir. Where that is unset, one under
    the warehouse folder is taken in local mode, as in tests; a cluster has to name one.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Remove the checkpoint of a settled frame that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in a session whose Python workers find this package (where it isn't installed, by its folder)."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

