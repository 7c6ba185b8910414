"""Binary files in the shared folder, from inside tasks.

A path may be a URI of any file system that pyarrow knows; the driver qualifies
folders, so one without a scheme lies where Spark puts it, not on the task's
own disk. A file system that pyarrow doesn't know is an error. A task writes under
a name of its own and returns it in its rows; only names that reach a stored
table count, so a lost or repeated attempt leaves at most an unused file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def new_file(folder: str, stem: str, suffix: str) -> tuple[str, object]:
    """(uri, stream) of a new file for writing."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_file(uri: str):
    """The file for reading, with seek."""
    system, path = _open(uri)
    return system.open_input_file(path)
