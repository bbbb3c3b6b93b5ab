"""Binary files that tasks write and read in the shared folder (pyarrow file systems)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_whole(folder: str, name: str, fill: Callable) -> str:
    """Write ``folder/name`` under another name first and move it into place, so
    that readers and repeated attempts of a task only ever see a whole file."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        fill(out)
    system.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"
