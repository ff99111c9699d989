"""Files that tasks open themselves, and an MD5 that is handed on from task to task."""

from __future__ import annotations

import ctypes
import functools
import math
import struct

# Bytes that a task holds of a file.
CHUNK = 4 << 20

# Fixed values of MD5: the state before the first block, the turns and the additions of its steps.
MD5_START = bytes.fromhex("0123456789abcdeffedcba9876543210")
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def store_of(path: str) -> tuple:
    """The file system of a path or URI, and the name of the file there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def is_local(folder: str) -> bool:
    """Whether a folder is mounted, so that a file takes writes at any place."""
    return folder.startswith(("/", "file:"))


@functools.cache
def _update():
    """The update of the library behind ``hashlib``, if it can be called."""
    try:
        import _hashlib

        return ctypes.CDLL(_hashlib.__file__).MD5_Update
    except (ImportError, AttributeError, OSError):
        return None


def md5_blocks(state: bytes, data: bytes) -> bytes:
    """The state of an MD5 behind whole blocks of 64 bytes."""
    update = _update()
    if update is None:
        return _md5_steps(state, data)
    # Four words of state, the length, a block that is not whole, and how much of that there is.
    held = ctypes.create_string_buffer(state, 92)
    update(held, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))
    return held.raw[:16]


def _md5_steps(state: bytes, data: bytes) -> bytes:
    """The same in Python, a hundred times slower."""
    words = struct.unpack("<4I", state)
    for block in struct.iter_unpack("<16I", data):
        a, b, c, d = words
        for i in range(64):
            if i < 16:
                f, g = (b & c) | (~b & d), i
            elif i < 32:
                f, g = (d & b) | (~d & c), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | (~d & 0xFFFFFFFF)), (7 * i) % 16
            f = (a + f + _ADD[i] + block[g]) & 0xFFFFFFFF
            a, d, c, b = d, c, b, (b + (f << _TURNS[i] | f >> (32 - _TURNS[i]))) & 0xFFFFFFFF
        words = [(x + y) & 0xFFFFFFFF for x, y in zip(words, (a, b, c, d), strict=True)]
    return struct.pack("<4I", *words)


def md5_piece(path: str, state: bytes, start: int, stop: int, size: int) -> bytes:
    """The state behind bytes ``start`` to ``stop`` of a file, from the one before.

    Both are multiples of 64, but for the end of the file: the state there is the MD5 of the file.
    """
    store, name = store_of(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        while start < stop:
            data = file.read(min(CHUNK, stop - start))
            if not data:
                raise ValueError(f"{path} ends before byte {stop}")
            start += len(data)
            if start == size:
                data += b"\x80" + bytes((55 - size) % 64) + struct.pack("<Q", 8 * size & (2**64 - 1))
            state = md5_blocks(state, data)
    return state
