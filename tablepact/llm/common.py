"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_written: dict[str, SparkSession] = {}
_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a local folder is made if there
    is one machine only (tests); on a cluster that is an error, as executors wouldn't see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="tablepact-"))
        root = _own_root[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_path(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended
        return


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``. All that is read from them must be written by then."""
    for t in tables:
        drop_path(t._scratch)


def drop_scratch() -> None:
    """Delete every folder that ``materialize`` and ``scratch_path`` have given out; results that still read them must be written first."""
    for path in list(_written):
        drop_path(path)


atexit.register(drop_scratch)


def only_new(cols: list[str], made: tuple[str, ...]) -> None:
    """Columns that an operator passes through must have names of their own."""
    if len({*cols, *made}) < len(cols) + len(made):
        raise ValueError(f"columns {cols} and {list(made)} must have different names")


def unused(cols: Iterable[str], name: str) -> str:
    """``name``, longer by underscores as far as columns already have it; names that differ in case only are one."""
    taken = {c.lower() for c in cols}
    while name.lower() in taken:
        name += "_"
    return name


def text_id(col: Column) -> Column:
    return col.cast("string").cast("binary")


def fold(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls in fold -1."""
    return F.coalesce(F.crc32(text_id(col)) % mod, F.lit(-1))


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` in each; one longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_text(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = max(at + 1, min(end, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values; null values are empty."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
