"""Arrays in the shared folder, written by tasks and memory-mapped by workers.

A local or mounted folder is mapped in place. From another store a worker copies a file to its own
temporary folder once, and maps the copy.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def save(path: str, values: np.ndarray) -> None:
    """Write an array under its final name in one step, so a repeated task replaces it by the same."""
    data = np.ascontiguousarray(values).tobytes()
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(name), recursive=True)
        with store.open_output_stream(name) as f:
            f.write(data)


@lru_cache(maxsize=512)
def load(path: str, kind: str) -> np.ndarray:
    """A stored array, mapped read-only."""
    local = _local(path)
    if not local:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as source, tempfile.NamedTemporaryFile(delete=False) as f:
            while part := source.read(1 << 24):
                f.write(part)
            local = f.name
    if not os.path.getsize(local):
        return np.empty(0, dtype=kind)
    return np.memmap(local, dtype=kind, mode="r")
