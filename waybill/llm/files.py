"""Files that tasks write into a shared folder.

A task writes under a name of its own attempt, and its row in the result names that
file. The result is stored, so only files of tasks that succeeded are ever read: a lost
executor or a second attempt leaves a stray file, never a half-written one in use.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path on a mounted folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def attempt_name(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """A new file for writing; makes its folder."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)
