"""What readers and writers of tables don't offer: names that only one writer can take, versions in their order, and deletion.

These are calls of the driver to the file system that Spark itself uses, for small files and names only.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

DIGITS = 12
NAMING_S = 3
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("staged", default=None)
_LEFT: list[tuple[SparkSession, str]] = []


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def take(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist; false if another writer has it."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001  the bridge's error wraps the file system's
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def publish(spark: SparkSession, folder: str, version: str) -> int:
    """Name a version as the one that follows all named so far. A number belongs to the writer who creates its file first, so
    the order doesn't depend on clocks."""
    while True:
        taken = names(spark, f"{folder}/published")
        number = int(taken[-1]) + 1 if taken else 1
        if take(spark, f"{folder}/published/{number:0{DIGITS}d}", version):
            return number


def published(spark: SparkSession, folder: str, most: int | None = None) -> list[str]:
    """Versions from the last named on. A number whose writer stopped before it gave the name counts as not named."""
    found = []
    for name in reversed(names(spark, f"{folder}/published")):
        if version := _content(spark, f"{folder}/published/{name}"):
            found.append(version)
            if len(found) == most:
                break
    return found


def state(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The last number that is taken (0: none) and the version that was named last. A number that has no name yet is waited for;
    after NAMING_S its writer counts as lost."""
    taken = names(spark, f"{folder}/published")
    until = time.monotonic() + NAMING_S
    while taken and not _content(spark, f"{folder}/published/{taken[-1]}") and time.monotonic() < until:
        time.sleep(0.1)
    found = published(spark, folder, 1)
    return int(taken[-1]) if taken else 0, found[0] if found else None


def new_version(folder: str) -> tuple[str, str]:
    version = uuid.uuid4().hex
    return version, f"{folder}/versions/{version}"


def prune(spark: SparkSession, folder: str, keep: int, used: set[str] | None = None) -> None:
    """Delete versions that were followed by keep others, and their names, unless they are among used. Versions that were
    never named may still be written and stay."""
    for name in names(spark, f"{folder}/published")[:-keep]:
        version = _content(spark, f"{folder}/published/{name}")
        if version and version not in (used or ()):
            delete(spark, f"{folder}/versions/{version}")
            delete(spark, f"{folder}/published/{name}")


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """The shuffles of what runs in this block are deleted as each run ends, not when the driver next collects garbage: what was
    written by them isn't made again."""
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def staged(spark: SparkSession, path: str) -> None:
    """Note an intermediate table: it goes with the scratch block that it was written in, else at the end of the program."""
    (_LEFT if (block := _STAGED.get()) is None else block).append((spark, path))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables that are written in this block are deleted at its end, when what was made of them is written."""
    block: list[tuple[SparkSession, str]] = []
    before = _STAGED.set(block)
    try:
        yield
    finally:
        _STAGED.reset(before)
        for spark, path in block:
            delete(spark, path)


@atexit.register
def _leave() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, path)
