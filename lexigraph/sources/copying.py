"""Tables copied from store to store, file by file and in parallel, with a manifest and checksums; a copy that was cut off goes on where it ended."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.shared import cut

from .store import open_at

MANIFEST = "file string, n_bytes long, sha256 string, copied boolean"


def listed(uri: str) -> list[tuple[str, int]]:
    """(path below uri, bytes) of all its files; marks and hidden files are left out, as readers do."""
    from pyarrow import fs

    system, top = open_at(uri)
    if system.get_file_info(top).type == fs.FileType.File:
        return [("", system.get_file_info(top).size)]
    found = system.get_file_info(fs.FileSelector(top, recursive=True))
    names = ((f.path[len(top) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File)
    return sorted((n, size) for n, size in names if not any(p.startswith((".", "_")) for p in n.split("/")))


def digest(system, path: str, step: int) -> tuple[str, int]:
    h, n = hashlib.sha256(), 0
    with system.open_input_stream(path) as f:
        while data := f.read(step):
            h.update(data)
            n += len(data)
    return h.hexdigest(), n


def copy_table(spark: SparkSession, source: str, target: str, step: int = 8 << 20) -> DataFrame:
    """The manifest of a copy: file, n_bytes, sha256 of the source's bytes, and whether it was copied now. A file is streamed to a temporary name, read back, compared and only then given its name, so target never holds a part of a file under it; a file whose target has its size and digest is left alone. Files of target
    that source lacks stay. An empty source gives an empty manifest."""
    files = listed(source)
    if not files:
        return spark.createDataFrame([], MANIFEST)

    def run(batches):
        (src, top), (dst, base) = open_at(source), open_at(target)
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (f"{t}/{name}" if name else t for t in (top, base))
                info, done = dst.get_file_info(b), False
                if info.is_file and info.size == size:
                    sha, n = digest(src, a, step)
                    done = digest(dst, b, step) == (sha, n)
                if not done:
                    part = f"{b.rpartition('/')[0]}/_copying-{b.rpartition('/')[2]}"
                    dst.create_dir(b.rpartition("/")[0], recursive=True)
                    h, n = hashlib.sha256(), 0
                    with src.open_input_stream(a) as f, dst.open_output_stream(part, compression=None) as out:
                        while data := f.read(step):
                            h.update(data)
                            out.write(data)
                            n += len(data)
                    sha = h.hexdigest()
                    if digest(dst, part, step) != (sha, n):
                        raise OSError(f"{b} differs from {a} after it was copied")
                    dst.move(part, b)
                yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [n], "sha256": [sha], "copied": [not done]})

    # a task a file: sizes differ, and a lost task is done again by itself
    table = spark.createDataFrame(files, "file string, n_bytes long").repartition(min(len(files), 10_000), "file")
    return cut(table.mapInArrow(run, MANIFEST), "manifest")


def differing(spark: SparkSession, manifest: DataFrame, target: str, step: int = 8 << 20) -> DataFrame:
    """Files of a manifest that target lacks or holds with other bytes."""

    def run(batches):
        dst, base = open_at(target)
        for batch in batches:
            names, sizes, shas = (c.to_pylist() for c in batch.columns)
            wrong = []
            for name, size, sha in zip(names, sizes, shas, strict=True):
                b = f"{base}/{name}" if name else base
                wrong.append(not dst.get_file_info(b).is_file or digest(dst, b, step) != (sha, size))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"]).filter(pa.array(wrong, pa.bool_()))

    return manifest.select("file", "n_bytes", "sha256").mapInArrow(run, "file string").orderBy(F.col("file"))
