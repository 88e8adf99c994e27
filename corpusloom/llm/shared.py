"""Arrays in the shared folder: written by one task under a name of its own, read by others through a memory map."""

from __future__ import annotations

import io
import mmap
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Appears whole or not at all, so a task that runs twice does no harm."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        np.save(part := f"{path}/.{name}-{uuid.uuid4().hex}.npy", array)
        os.replace(part, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    np.save(data := io.BytesIO(), array)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    with system.open_output_stream(part) as out:
        out.write(data.getvalue())
    system.move(part, f"{path}/{name}.npy")


def _mapped(path: str) -> np.ndarray:
    """The array of a file through a map that keeps no descriptor of it: a process may hold fewer of those than maps. A short one is read."""
    if os.path.getsize(path) <= 128:
        return np.load(path)
    with open(path, "rb") as file:
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(file) == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(file)
        pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        return np.ndarray(shape, kind, pages, file.tell())


def load(folder: str, name: str, kind: str) -> np.ndarray:
    """A memory-mapped array, empty if nobody wrote it. Where the folder is no mount, a copy is fetched and unlinked once it is mapped."""
    if (path := _local(folder)) is not None:
        path = f"{path}/{name}.npy"
        if not os.path.exists(path):
            return np.zeros(0, kind)
        return _mapped(path)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{path}/{name}.npy").type == fs.FileType.NotFound:
        return np.zeros(0, kind)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy, system.open_input_stream(f"{path}/{name}.npy") as data:
        while piece := data.read(1 << 22):
            copy.write(piece)
        copy.flush()
        return _mapped(copy.name)


def shard_count(parts: int) -> int:
    """A power of two of at least four shards a shuffle partition."""
    return 1 << max(4, (4 * parts - 1).bit_length())
