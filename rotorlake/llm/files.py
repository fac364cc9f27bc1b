"""Byte files in the shared folder, written and read by tasks."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, ...) or plain path, and the path in it."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """A stream to a file that appears under its name only when it is whole.

    Each attempt writes to a name of its own and then moves it, so retried and speculative tasks leave one file.
    """
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with store.open_output_stream(part, compression=None) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, path)
