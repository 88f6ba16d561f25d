"""Files in the shared folder, opened by executors through whatever store the folder lies in."""

from __future__ import annotations

import mmap


def _store(uri: str):
    from pyarrow import fs

    if ":" not in uri.split("/", 1)[0]:
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file for sequential writing; its folder is made where the store has folders."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def open_random(uri: str):
    """A file for reads at any offset."""
    store, path = _store(uri)
    return store.open_input_file(path)


def mapped(uri: str):
    """The bytes of a file: memory-mapped where the store is a mounted folder, else read."""
    from pyarrow import fs

    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as file:
            file.seek(0, 2)
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if file.tell() else b""
    with store.open_input_file(path) as file:
        return file.read()
