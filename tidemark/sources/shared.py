"""Small files that several runs share: written whole or not at all, on the driver's disk or any store that Spark reaches."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _session() -> SparkSession | None:
    """This thread's session, or the one that was made last (threads of a pool have none of their own)."""
    return SparkSession.getActiveSession() or SparkSession._instantiatedSession


def _local(path: str) -> str | None:
    """The path on the driver's own disk; None for a URI of another store."""
    found = re.match(r"([a-z][a-z0-9+.-]+):/", path)
    return path if not found else re.sub(r"^file:/+", "/", path) if found[1] == "file" else None


def _store(path: str):
    """The JVM, the file system and the path of a URI."""
    spark = _session()
    if spark is None:
        raise RuntimeError(f"reading or writing {path} needs a Spark session")
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_text(path: str) -> str:
    """The file's text; FileNotFoundError if there is none."""
    if (local := _local(path)) is not None:
        return Path(local).read_text(encoding="utf-8")
    jvm, fs, at = _store(path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Puts the file in place by renaming one that is whole, so readers meet the old text or the new, and no part of either."""
    if (local := _local(path)) is not None:
        target = Path(local)
        target.parent.mkdir(parents=True, exist_ok=True)
        other = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        other.write_text(text, encoding="utf-8")
        os.replace(other, target)
        return
    jvm, fs, at = _store(path)
    other = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(other, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    spark = _session()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(other, at, how)


def names_in(folder: str) -> list[str]:
    """Names of the files in a folder, in order; none if there is no folder."""
    if (local := _local(folder)) is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    _, fs, at = _store(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def load_json(path: str | None, default):
    """The file's content if it is of default's type; default otherwise."""
    try:
        found = json.loads(read_text(path))
    except (OSError, TypeError, ValueError):
        return default
    return found if isinstance(found, type(default)) else default


class Journal:
    """A JSON file and what runs have added to it since: each addition is a file of its own, so none is lost to another run.

    The additions to `path` lie in the folder `path`.d, under names that sort by time.
    """

    def __init__(self, path: str, default):
        self.path, self.default = str(path), default

    def read(self) -> tuple[object, list]:
        """The file's content and all additions, oldest first; what can't be read is passed over."""
        folder = f"{self.path}.d"
        added = [load_json(f"{folder}/{n}", self.default) for n in names_in(folder) if n.endswith(".json") and not n.startswith(".")]
        return load_json(self.path, self.default), added

    def add(self, at: str, what) -> None:
        write_text(f"{self.path}.d/{at}-{uuid.uuid4().hex}.json", json.dumps(what, default=str, ensure_ascii=False))
