"""Byte files that executors write to and read from the shared folder."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a ``file:``, ``hdfs:``, ``s3:`` ... URI or a plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def attempt_name(folder: str, part: int, suffix: str) -> str:
    """A name of its own for each attempt of a task: a retried task never meets half a file."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"
