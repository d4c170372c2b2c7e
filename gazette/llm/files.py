"""Files in the shared folder that Python workers write and read themselves.

Names hold the task attempt, and only files named in a manifest that Spark's committer wrote are ever
read: what a lost or repeated attempt leaves behind is ignored.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    context = TaskContext.get()
    part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
    return f"{prefix}-{part:06d}-{attempt}-{uuid.uuid4().hex[:8]}{suffix}"
