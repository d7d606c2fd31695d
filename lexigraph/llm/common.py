"""What the operators share: files on any store, text blocks, folds."""

from __future__ import annotations

import ctypes
import re
import zlib

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.shared import cut, new_path, remove, shared_dir  # noqa: F401


def store(uri: str):
    """(file system, path) of a URI, for code on executors."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) else "file://" + uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, mod n."""
    return zlib.crc32(str(doc_id).encode()) % n


def fold_col(col, n: int):
    return F.crc32(col.cast("string").cast("binary")) % n


def utf8(value: str | None) -> bytes:
    """Lone surrogates cannot come out of Spark; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def trim() -> None:
    """Gives memory that a worker process no longer uses back to the system, as the process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def in_blocks(batches, budget: int = 4 << 20, text: str = "text", most: int = 4096):
    """Arrow batches cut so that the text column of each holds about budget bytes; a longer text stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = [x.as_py() or 0 for x in pa.compute.binary_length(col)]
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > budget or i - at >= most):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield batch.slice(at)
    trim()
