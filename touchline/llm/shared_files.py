"""Flat arrays in the shared folder, written by tasks and mapped by workers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """The bytes of all arrays; under its name only when it is whole, and a repeated task writes the same."""
    store, name = _place(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    store.move(part, name)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file, mapped, none if there is no file; one from another store is fetched and unlinked first."""
    store, name = _place(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, np.uint8)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(name, compression=None) as source:
            while piece := source.read(1 << 22):
                copy.write(piece)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")
