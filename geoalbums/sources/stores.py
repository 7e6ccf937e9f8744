"""Files of any store, read and written where the rows are."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import TypeVar

from pyarrow import fs

_Found = TypeVar("_Found")

_STORES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}  # Hadoop's names of Arrow's stores
_PAUSES = (0.2, 1.0)  # seconds before a second and a third try


def store_of(path: str) -> tuple[str, str]:
    """Arrow's URI of the store a Hadoop path is in (empty: the local one), and the path inside, as it stands."""
    scheme, at, rest = path.partition(":")
    if not at or "/" in scheme or scheme == "file":
        return "", re.sub(r"\Afile:/+", "/", path)
    if scheme == "dbfs":  # mounted on every executor
        return "", "/dbfs/" + rest.lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    if scheme in ("wasb", "wasbs"):  # Arrow finds the container in names of the other endpoint only
        authority = authority.replace(".blob.", ".dfs.", 1)
    return f"{_STORES.get(scheme, scheme)}://{authority}/", inner


def located(path: str) -> tuple[fs.FileSystem, str]:
    store, inner = store_of(path)
    if not store:
        return fs.LocalFileSystem(), inner
    filesystem, root = fs.FileSystem.from_uri(store)
    return filesystem, f"{root.rstrip('/')}/{inner}"


def open_file(path: str):
    filesystem, inner = located(path)
    return filesystem.open_input_stream(inner)


def write_file(path: str, content: bytes) -> None:
    """One file, with the folders above it; a task that runs again writes it again."""
    filesystem, inner = located(path)
    filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(inner) as stream:
        stream.write(content)


def remove_file(path: str) -> None:
    """The file goes; a task that runs again finds it gone."""
    filesystem, inner = located(path)
    if filesystem.get_file_info(inner).type != fs.FileType.NotFound:
        filesystem.delete_file(inner)


def reason_of(error: Exception) -> str:
    """Why a file or folder is left out, in words that do not depend on the store."""
    if isinstance(error, FileNotFoundError):
        return "not found"
    if isinstance(error, NotADirectoryError):
        return "not a folder"
    if isinstance(error, PermissionError):
        return "not permitted"
    return f"cannot be read: {(str(error).splitlines() or [type(error).__name__])[0]}"


def tried(what: Callable[[], _Found]) -> tuple[_Found | None, str | None]:
    """The result of `what` and no reason, or none and the reason. What a store refuses for a moment is
    asked for again; what is not there or not allowed is not."""
    for pause in (*_PAUSES, None):
        try:
            return what(), None
        except (FileNotFoundError, NotADirectoryError, PermissionError) as error:
            return None, reason_of(error)
        except Exception as error:  # whatever a store raises: the reason goes into the rows
            if pause is None:
                return None, reason_of(error)
            time.sleep(pause)
    raise AssertionError
