"""Path checks through Spark's own file systems (the session's default one where a path names none)."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` (file or folder) exists."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(name, bytes, modified)`` of the data files of a file or folder, at any depth; empty if
    there is none. Hidden files (``_``, ``.``) are left out."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def head(spark: SparkSession, uri: str, size: int) -> bytes:
    """The first bytes of the file at a URI, of a compressed one those of its text."""
    p, fs = _path(spark, spark._jvm.java.net.URI(uri))
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p)
    stream = fs.open(p) if codec is None else codec.createInputStream(fs.open(p))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def publish(spark: SparkSession, staged: str, path: str, replace: bool = False) -> bool:
    """Renames a finished folder to ``path``; False if ``path`` is there already and is not to be
    replaced. Of several builders one wins, and no reader sees a part of a table. A table that is to be
    replaced is first moved aside, and back if the rename fails; between the two no table is there, so
    tables with readers are better published as versions (``publish_version``)."""
    target, fs = _path(spark, path)
    old = None
    if fs.exists(target):
        if not replace:
            return False
        old = _path(spark, f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}")[0]
        if not fs.rename(target, old):
            raise OSError(f"cannot move {path} aside")
    fs.mkdirs(target.getParent())
    # renaming onto a folder that appeared meanwhile would move the table into it
    done = not fs.exists(target) and bool(fs.rename(_path(spark, staged)[0], target))
    if old is not None:
        if done:
            fs.delete(old, True)
        elif not fs.exists(target):
            fs.rename(old, target)
    return done


_VERSION = re.compile(r"v([0-9]{10})(\.done)?")


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the version folders of a table, and of those that are committed."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return [], []
    names = [_VERSION.fullmatch(f.getPath().getName().lstrip("_")) for f in fs.listStatus(p)]
    return sorted(int(m[1]) for m in names if m and not m[2]), sorted(int(m[1]) for m in names if m and m[2])


def publish_version(spark: SparkSession, staged: str, path: str, keep: int = 2) -> str:
    """Makes a finished folder the newest version of the table ``path``: it is renamed to a version of
    its own, and then a marker file appears, which is the commit. A reader at any moment, and a crash
    after any step, finds the version before or this one. Older versions but ``keep`` go afterwards, so that
    readers of the one before can end."""
    root, fs = _path(spark, path)
    fs.mkdirs(root)
    folders, done = _versions(spark, path)
    n = max([0, *folders, *done]) + 1
    target = f"{path.rstrip('/')}/v{n:010d}"
    if not fs.rename(_path(spark, staged)[0], _path(spark, target)[0]):
        raise OSError(f"cannot rename {staged} to {target}")
    # fails if another builder took the same number, whose table may then hold this one as a subfolder
    fs.create(_path(spark, f"{path.rstrip('/')}/_v{n:010d}.done")[0], False).close()
    for old in [v for v in done if v <= n - keep]:
        remove(spark, f"{path.rstrip('/')}/_v{old:010d}.done")
        remove(spark, f"{path.rstrip('/')}/v{old:010d}")
    return target


def current(spark: SparkSession, path: str) -> str | None:
    """The newest committed version of a table, None if there is none."""
    done = _versions(spark, path)[1]
    return f"{path.rstrip('/')}/v{done[-1]:010d}" if done else None


def versions(spark: SparkSession, path: str) -> list[str]:
    """All committed versions of a table that are still there, oldest first."""
    return [f"{path.rstrip('/')}/v{n:010d}" for n in _versions(spark, path)[1]]


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, new: str) -> None:
    """Moves a file, making the folders above its new place; a file there is replaced."""
    p, fs = _path(spark, path)
    target = _path(spark, new)[0]
    fs.mkdirs(target.getParent())
    fs.delete(target, False)
    if not fs.rename(p, target):
        raise OSError(f"cannot move {path} to {new}")


def touch(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for a job's intermediate tables. It goes when the driver's
    process ends."""
    from encore.session import shared_dir

    path = f"{shared_dir(spark)}/encore/tmp/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            remove(spark, path)

    atexit.register(drop)
    return path
