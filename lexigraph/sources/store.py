"""Files on any store, from code on executors."""

from __future__ import annotations

import re


def open_at(uri: str):
    """(file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    system, name = fs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) else "file://" + uri)
    return system, name.rstrip("/")


def open_output(uri: str):
    system, name = open_at(uri)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)
